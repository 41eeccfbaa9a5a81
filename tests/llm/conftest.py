from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parent))

def odd_documents() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, copies, repeated rows and shared passages."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(400)] + ["é", "ñandú", "中文", "x.", "|"]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, other = some(60), some(20)
    base = some(90).split()
    rows = [(i, some(rng.randrange(1, 160)), rng.choice(["en", "de"]), f"src{rng.randrange(3)}") for i in range(60)]
    rows += [(100 + i, f"{some(10)} {passage} {some(10)}", "en", "src0") for i in range(12)]
    rows += [(200 + i, " ".join(base), "de", "src0") for i in range(5)]
    for i in range(12):
        near = list(base)
        for k in rng.sample(range(90), i % 4):
            near[k] = "zz" + near[k]
        rows.append((300 + i, " ".join(near), "de", "src1"))
    rows += [(400, None, "en", "src0"), (401, "", "en", "src0"), (402, " \t\n\x0b\f\r ", None, None), (403, "one", "en", None), (404, "12 !!! \x00\x1c\x85", None, "src9"), (405, some(30_000), "en", "src2"), (406, "a " * 5000, "en", "src2"), (407, "all rights reserved. CC BY and the General Public-License; all rights reserved", "en", "x")]
    rows += [(408, f"{other.upper()}  {other}", "en", "src0"), (409, "   x  y\n\nz <|endoftext|> it's 3.5, don’t", "en", "src0")]
    rows += [(None, passage, "en", "src0"), (3, *rows[3][1:]), (3, *rows[3][1:])]
    return rows


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())])
#: Columns that operators also use inside.
CLASHES = ("score", "label", "bucket", "part", "kept", "starts", "at", "n", "id", "features", "signature", "block", "group", "rep")


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """A folder of small tables that hold every odd case, with extra columns."""
    folder = tmp_path_factory.mktemp("odd")
    rows = odd_documents()
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "length(text) AS n_chars", *[f"'x' AS {c}" for c in CLASHES])
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    toxic = [(r[0], 1, int(r[0] is not None and r[0] % 9 == 0)) for r in rows if r[0] is None or r[0] % 2] + [(5, None, None), (5, 0, 1), (None, None, 1)]
    spark.createDataFrame(toxic, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(1, " ".join(rows[70][1].split()[12:52])), (2, None), (3, ""), (4, "too short"), (None, rows[5][1]), (6, "no document holds these words at all that are written here now")]
    spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS doc_id", "2 AS n_words", *[f"'x' AS {c}" for c in CLASHES]).write.parquet(f"{folder}/benchmark.parquet")
    rng = random.Random(5)
    vector = lambda: [rng.choice([-1.5, 0.25, 0.1, 2.0, 0.0009]) for _ in range(6)]
    same = vector()
    vectors = [(i, vector()) for i in range(150)] + [(200 + i, same) for i in range(40)] + [(300, None), (301, []), (302, [None] * 6), (303, [float("nan")] * 6), (304, [float("inf")] * 6), (400, [1.0, 2.0]), (401, [2.0, 1.0]), (None, same), (7, vector()), (7, same)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS v", "1 AS part", "2 AS score").write.parquet(f"{folder}/embeddings.parquet")
    magic = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:777>\r\nContent-Length: 5\r\n\r\nxxxxx\r\n\r\n"
    pages = [(i, f"http://x/{i}", ("<p>" + "a" * (i % 5) * 400) + magic * (i % 3) + "é" * (i % 2)) for i in range(40)] + [(100, None, None), (101, "a b\r\nc", ""), (102, "u", magic * 40), (103, "u", "WARC/1.1\r\n"), (104, "u", "y" * 300_000)]
    spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' AS digest", "1 AS bytes").write.parquet(f"{folder}/pages.parquet")
    return str(folder)




@pytest.fixture(scope="session")
def empty(spark, odd, tmp_path_factory):
    """The same tables without rows."""
    folder = tmp_path_factory.mktemp("empty")
    for t in ("documents", "labels", "benchmark", "embeddings", "pages"):
        spark.read.parquet(f"{odd}/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)
