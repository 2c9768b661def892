"""A declarative SQL serving engine on PySpark."""
