"""Column expressions: everything here returns a ``pyspark.sql.Column`` built
from Spark built-ins, so it runs inside whole-stage codegen."""
