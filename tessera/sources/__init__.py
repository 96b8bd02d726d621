"""Sources: Matrix Market and vector text readers, the driver tables as matrices."""
