"""Rows of a query beside those of its SQL."""

import os


def rows(table) -> list:
    names = sorted(table.column_names)
    value = lambda x: round(float(x), 6) if type(x).__name__ in ("float", "Decimal") else x
    return sorted((tuple(value(v) for v in r) for r in zip(*(table[n].to_pylist() for n in names))), key=repr)


def expected(sql: str, folder: str):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    return con.sql(sql).to_arrow_table()
