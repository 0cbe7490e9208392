"""Type classes used to decide whether two columns may be compared."""

from pyspark.sql import types as T

FLOATS = (T.FloatType, T.DoubleType)
TEXTS = (T.StringType, T.CharType, T.VarcharType)
DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)
NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)

# Type names accepted per family by the type expectation.
TYPE_ALIASES = {
    "int64": ["int", "integer", "int64"],
    "float64": ["float", "float64", "double"],
    "object": ["object", "string", "str"],
    "bool": ["bool", "boolean"],
}


def type_class(dtype):
    """`numeric`, `string` or `date`; any other type is its own class."""
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, TEXTS):
        return "string"
    if isinstance(dtype, DATES):
        return "date"
    return dtype.simpleString()


def compatible(left, right):
    return type_class(left) == type_class(right)


def family(dtype):
    """Family name matched against the aliases of a type expectation."""
    if isinstance(dtype, T.IntegralType):
        return "int64"
    if isinstance(dtype, FLOATS):
        return "float64"
    if isinstance(dtype, TEXTS):
        return "object"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    return dtype.simpleString()


def is_type(dtype, wanted):
    wanted = wanted.lower()
    name = family(dtype)
    return wanted in TYPE_ALIASES.get(name, [name]) or wanted in (name, dtype.simpleString())


def text_length(field):
    """Declared char/varchar length of a schema field, or None."""
    if isinstance(field.dataType, (T.CharType, T.VarcharType)):
        return field.dataType.length
    declared = field.metadata.get("__CHAR_VARCHAR_TYPE_STRING", "")
    return int(declared.split("(")[1].rstrip(")")) if "(" in declared else None


def precision_scale(dtype):
    return (dtype.precision, dtype.scale) if isinstance(dtype, T.DecimalType) else (None, None)
