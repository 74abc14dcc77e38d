"""The corpus pipeline: each stage on its own input against a plain version."""

import collections
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from plain_versions import plain_clean, plain_components, plain_contamination
from pyspark.sql import functions as F

import corpus_pipeline
from quadrille.llm.session import written

SMALL = "/root/testdata/sf0.001"
FOOTER = " ".join(f"foot{k}" for k in range(24))


def save(path, docs):
    pq.write_table(pa.Table.from_pylist(docs, schema=pq.read_schema(f"{SMALL}/documents.parquet")), os.path.join(path, "documents.parquet"))
    pq.write_table(pq.read_table(f"{SMALL}/benchmark.parquet"), os.path.join(path, "benchmark.parquet"))
    return path


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """A table with nulls, copies, repeated rows and a host whose documents share a line, beside the small one."""
    docs = pq.read_table(f"{SMALL}/documents.parquet").to_pylist()
    docs += [docs[0], {**docs[1], "doc_id": 9001}, {**docs[2], "doc_id": 9002, "text": docs[2]["text"] + " end"}, {**docs[3], "doc_id": 9003, "text": None}, {**docs[4], "doc_id": 9004, "text": ""}, {**docs[5], "doc_id": None}]
    own = lambda k: " ".join(f"own{k}x{j}" for j in range(40))
    docs += [{"doc_id": 9100 + k, "text": f"{FOOTER}\n{own(k)}", "lang": None, "source": "footed", "n_chars": 0} for k in range(8)]
    docs += [{"doc_id": 9200, "text": FOOTER, "lang": None, "source": "footed", "n_chars": 0}, {"doc_id": 9201, "text": FOOTER.upper(), "lang": None, "source": None, "n_chars": 0}]
    return save(str(tmp_path_factory.mktemp("data")), docs)


def counted(df):
    return collections.Counter((r["doc_id"], r["text"]) for r in df.collect())


def stages(spark, docs, folder):
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        tables.append(written(stage(spark, tables[-1], folder), "stage"))
        assert tables[-1].columns == docs.columns
    return tables


def test_stages(spark, folder):
    tables = stages(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    raw, known, good, single, clean = map(counted, tables)
    assert known == collections.Counter({k: n for k, n in raw.items() if k[1] and any(c.isalpha() for c in k[1])})
    assert good == collections.Counter(plain_clean([(r["doc_id"], r["text"], r["source"]) for r in tables[1].collect()]))
    # the shared line is gone from its host, the document that held nothing else as well, and other hosts keep it
    assert not any(FOOTER in t for i, t in good if i and 9100 <= i < 9108) and (9200, FOOTER) not in good and (9201, FOOTER.upper()) in good
    assert {r["n_chars"] - len(r["text"]) for r in tables[2].where("doc_id BETWEEN 9100 AND 9107").collect()} == {0}
    groups = collections.defaultdict(set)
    rows = list(good)
    for (i, _, component), _ in plain_components(rows).items():
        groups[component].add(i)
    assert collections.Counter(i for i, _ in single.elements()) == collections.Counter(groups.keys())
    bench = [(r["item_id"], r["text"]) for r in pq.read_table(f"{folder}/benchmark.parquet").to_pylist()]
    hit = {k[0] for k in plain_contamination(list(single), bench) if k[-1]}
    assert clean == collections.Counter({k: n for k, n in single.items() if k[0] not in hit})
    out = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == {i for i, _ in clean}


def test_clashing_columns_pass_through(spark, folder):
    names = ("kept", "gone", "score", "lang_pred", "component_id", "row", "host", "line", "key", "fp", "doc", "contaminated", "n_words", "start")
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 60 OR doc_id > 9000").withColumns({c: F.lit("clash") for c in names})
    last = stages(spark, docs, folder)[-1]
    assert last.count() > 20 and last.where(" OR ".join(f"{c} <> 'clash'" for c in names)).isEmpty()
    packed = corpus_pipeline.STAGES[-1][1](spark, last, folder)
    assert packed.select("doc_id").distinct().count() == last.select("doc_id").distinct().count()


def test_empty_tables(spark, tmp_path):
    folder = save(str(tmp_path), [])
    tables = stages(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert all(t.isEmpty() for t in tables) and corpus_pipeline.run(spark, folder).isEmpty()


def test_a_corpus_without_labels_is_kept(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.STAGES[0][1](spark, docs, folder)
    assert kept.count() == docs.where("text RLIKE '[a-zA-Z]'").count() > 200


def test_shape_of_the_module():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "quality rules", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None
