"""Catalog tables, JDBC tables and SQL queries, narrowed by columns, predicate, keys and limit."""

from twinframe.operators.align import lower_columns


def normalize_where(text):
    """Predicate text without a leading WHERE; None if blank."""
    text = (text or "").strip()
    if text[:6].lower() == "where ":
        text = text[6:].strip()
    return text or None


def positive_limit(value):
    if value is None:
        return None
    try:
        limit = int(value)
    except (TypeError, ValueError):
        limit = 0
    if limit <= 0:
        raise ValueError("'limit' must be a positive integer")
    return limit


def select_columns(df, columns):
    """The wanted columns that exist, in table order; an empty frame if there are none."""
    if not columns:
        return df
    wanted = {c.lower() for c in columns}
    found = [c for c in df.columns if c.lower() in wanted]
    return df.select(*found) if found else df.select().limit(0)


def read_table(spark, table=None, query=None, jdbc=None, schema=None, columns=None, where=None, limit=None):
    """A table or query as a frame, from the catalog or over JDBC options.

    Spark pushes the column choice, the predicate and the limit into the scan.
    """
    if not (table or query):
        raise ValueError("either 'table' or 'query' must be given")
    name = f"{schema}.{table}" if schema and table else table
    if jdbc:
        reader = spark.read.format("jdbc").options(**jdbc)
        df = (reader.option("query", query) if query else reader.option("dbtable", name)).load()
    else:
        df = spark.sql(query) if query else spark.table(name)
    if not query:
        df = select_columns(df, columns)
        if normalize_where(where):
            df = df.where(normalize_where(where))
    limit = positive_limit(limit)
    return lower_columns(df.limit(limit) if limit else df)
