import random

import corpus_pipeline
import pytest
from riskloom.llm import queries
from riskloom.llm.common import stored

import __spark_entry__

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def corpus(spark, frame, tmp_path):
    """Prose and junk, copies and near-copies, secrets, odd rows; as tables of a folder."""
    random.seed(12)
    stock = [f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)]
    texts = []
    for i in range(400):
        words = random.choices(stock, k=random.randint(25, 90))
        texts.append(" ".join(words).capitalize() + "." if i % 4 else " ".join(w.upper() + "!!" for w in words))
    near = texts[1].split()
    near[-3] = "anders"
    texts += [texts[1], " ".join(near), "Ein Satz mit token: 0123456789abcdef0123456789abcdef und mehr. " + " ".join(random.choices(stock, k=60)) + ".", None, "", " "]
    rows = [(i, t, "de", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[5], (None, texts[7], None, None, None)]
    docs, labels = frame(rows, COLUMNS), frame([(i, int(i % 4 != 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), rows


def test_stages_do_what_they_say(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = stored(corpus_pipeline.quality_stage(spark, docs, folder), "good")
    ids = [r.doc_id for r in good.collect()]
    assert good.columns == docs.columns and not [i for i in ids if i is not None and i < 400 and i % 4 == 0]
    assert len([i for i in ids if i is not None and i < 400]) >= 0.98 * 300

    single = stored(corpus_pipeline.near_dedup_stage(spark, good, folder), "single")
    left = sorted((r.doc_id for r in single.collect()), key=lambda i: -1 if i is None else i)
    assert single.columns == docs.columns and 1 in left and not {400, 401} & set(left) and left.count(5) == 1
    assert ids.count(None) == 1 and None not in left  # its text is that of document 7
    assert len(left) >= len(set(ids)) - 3

    clean = stored(corpus_pipeline.secrets_stage(spark, single, folder), "clean")
    texts = {r.doc_id: r for r in clean.collect()}
    assert clean.columns == docs.columns and len(texts) == len(left)
    assert "0123456789abcdef" not in texts[402].text and "[SECRET] und mehr." in texts[402].text and texts[402].n_chars == len(texts[402].text)
    assert all(texts[i].text == rows[i][1] for i in left if i is not None and i < 400)

    packed = corpus_pipeline.packing_stage(spark, clean, folder).collect()
    assert {p.doc_id for p in packed} == set(left)
    assert corpus_pipeline.run(spark, folder).count() == len(packed)


def test_rows_of_one_id_or_none_are_compared_by_their_texts(spark, frame):
    random.seed(4)
    base, other, third = (" ".join(random.choices([f"w{i}" for i in range(200)], k=80)) for _ in range(3))
    near = " ".join([*base.split()[:-1], "end"])
    rows = [(1, base, 9.0), (1, other, 9.0), (2, near, 9.0), (2, base, 9.0), (None, third, 9.0), (None, third, 9.0), (None, other, 9.0), (3, "", 9.0), (4, "", 9.0), (4, "", 9.0), (None, None, 9.0), (5, " ", 9.0)]
    docs = frame(rows, "doc_id long, text string, score double")
    left = corpus_pipeline.near_dedup_stage(spark, docs, "").collect()
    want = [(1, base), (1, other), (None, third), (3, ""), (4, ""), (None, None), (5, " ")]
    assert sorted(((r.doc_id, r.text) for r in left), key=str) == sorted(want, key=str)
    assert corpus_pipeline.secrets_stage(spark, docs, "").columns == docs.columns


def test_stages_of_an_empty_table(spark, frame, tmp_path):
    frame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = frame([], COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)), name.replace(" ", "-"))
        assert docs.count() == 0


def test_every_operator_is_registered(spark):
    registered = __spark_entry__.queries()
    assert set(queries.QUERIES) <= set(registered) and "pipeline" in registered
    assert {int(name[2:].split("_")[0]) for name in queries.QUERIES if name.startswith("op")} == set(range(1, 14))
