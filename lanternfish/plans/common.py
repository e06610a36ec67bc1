"""Registration of a query with its SQL."""

from __future__ import annotations


def registry() -> tuple[dict, dict, object]:
    """Empty QUERIES and ORACLE_SQL, and a decorator that fills them: @query(sql), or @query() where SQL can't express the query."""
    queries: dict = {}
    oracle: dict = {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracle[f.__name__] = sql
            return f

        return add

    return queries, oracle, query


def relation(spark, sf_dir: str, text: str):
    """The rows of a SELECT that both engines read alike; it names tables as {customer}."""
    from string import Formatter

    from lanternfish.sources.tables import table

    names = {name for _, name, _, _ in Formatter().parse(text) if name}
    return spark.sql(text, **{name: table(spark, sf_dir, name) for name in names})


def filed(spark, sf_dir: str, text: str, name: str):
    """The rows of a SELECT from one table with arrival: the file and the place in it that each comes from."""
    from lanternfish.sources.tables import table

    rows = table(spark, sf_dir, name).select("*", "_metadata.file_path", "_metadata.row_index")
    return spark.sql(text.replace("select ", "select struct(file_path, row_index) as arrival, ", 1), **{name: rows})


def plain(text: str) -> str:
    """The same SELECT for the other engine, where tables have their names."""
    return text.replace("{", "").replace("}", "")
