"""Rows of cells against the operators on single cells, and how often the lines behind them are shuffled."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from dossier import catalog
from dossier.operators import extraction, tables
from dossier.plans import registry

from .test_queries import SF, TABLES, plain

ROWS = "doc_id int, table_id string, r int, cells array<struct<c:int,row_span:int,col_span:int,text:string>>"


def grids(n):
    random.seed(7)
    for doc in range(n):
        taken, width = set(), random.randint(1, 5)
        for r in range(random.randint(1, 13)):
            cells = []
            for c in range(width):
                if (r, c) in taken or random.random() < 0.1:
                    continue
                rs, cs = random.choice([1, 1, 1, 2, 3]), random.choice([1, 1, 2])
                cs = 1 if (r, c + 1) in taken or c + 1 >= width else cs
                taken |= {(r + i, c + j) for i in range(rs) for j in range(cs)}
                number = random.random() < (0.05 if r < 2 else 0.4)
                cells.append((c, rs, cs, str(random.randint(0, 99)) if number else random.choice(["Name", "price", "Total", "total sum", "", None, "x"])))
            if cells:
                yield doc, "t", r, cells


def rows_of(df):
    return sorted(str(tuple(plain(r[c]) for c in sorted(df.columns))) for r in df.collect())


def test_columns_of_rows_are_those_of_cells(spark):
    rows = spark.createDataFrame(list(grids(150)), ROWS).repartition(3)
    cells = rows.select("doc_id", "table_id", "r", F.inline("cells"))
    data = cells.groupBy("doc_id", "table_id", "r").agg(F.max(F.col("text").rlike(r"^\d+$")).alias("data"))
    paths = tables.header_paths(tables.dense_cells(cells), tables.infer_headers(data, F.col("data"), F.lit(False)).select("doc_id", "table_id", "r", "is_header"))
    keywords = {"what": "name", "sum": "total", "both": "name / "}
    found = tables.column_rows(rows, F.exists("cells", lambda x: x["text"].rlike(r"^\d+$")), F.lit(False), keywords)
    got = found.where(" or ".join(f"{k} is not null" for k in keywords)).select("doc_id", "table_id", "r", *[F.col(k)["text"].alias(k) for k in keywords])
    want = tables.select_columns(cells, paths, keywords)
    assert rows_of(got) == rows_of(want) and want.where("both is not null").count() > 20
    assert rows_of(extraction.typed_rows(found, list(keywords), ["sum"])) == rows_of(extraction.spec_rows(cells, paths, keywords, ["sum"]))


def test_suppliers_of_rows_are_those_of_cells(spark):
    rows = spark.createDataFrame(list(grids(60)), ROWS)
    names = [(0, "a", "unit_price"), (1, "a", "row_total"), (2, "b", "row_total"), (3, "c", "unit_price"), (9, "d", "unit_price"), (2, "e", "other")]
    cells = rows.select("doc_id", "table_id", "r", F.inline("cells"))
    sources = cells.select("doc_id", "table_id").distinct().join(spark.createDataFrame(names, "c int, source string, measure string"), F.lit(True))
    own = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(s).alias("source"), F.lit(m).alias("measure")) for c, s, m in names])
    assert rows_of(tables.unpivot_rows(rows.withColumn("sources", own))) == rows_of(tables.unpivot_suppliers(cells, sources))


@pytest.mark.parametrize("name", ["select_columns", "spec_rows", "unpivot_suppliers", "dense_cells", "origin_cells", "table_kind"])
def test_lines_in_slices_bring_their_grid_in_one_pass(spark, monkeypatch, name):
    monkeypatch.setattr(registry, "SLICE_ROWS", 500)
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    cols = ", ".join(sorted(df.columns))
    assert rows_of(df) == sorted(str(tuple(map(plain, r))) for r in db.execute(f"SELECT {cols} FROM ({catalog.SQL[name]})").fetchall())
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and plan.count("REPARTITION_BY_NUM") == 2 and "hashpartitioning(doc_id" not in plan
