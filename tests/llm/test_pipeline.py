"""The pipeline, stage by stage, against plain Python on its own input."""

import re
from collections import defaultdict

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from flowmark.llm import secrets
from flowmark.llm.queries import tokenizer_file

from .tables import words
from .test_models import corpus
from .test_near import brute_force
from .test_native import PATTERNS, spans


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    rows = []
    for i, text, good, _ in corpus(300, 2):
        if i % 7 == 0:
            text += f" token=abcdefgh{i}"
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    base = words(200, 9)
    rows += [(1000 + i, " ".join([*base[:100], f"e{i}", *base[101:]]), "en", "s", 0) for i in range(5)]
    rows += [(2000 + i, rows[i][1], "en", "copy", rows[i][4]) for i in range(0, 300, 10)]
    rows += [(3000, None, "en", "s", None), (3001, "", None, None, 0), (3002, "one", "en", "s", 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, good, 0) for i, _, good, _ in corpus(300, 2) if i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet"
    )
    return str(folder)


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{k}")
        made.append((docs.collect(), spark.read.parquet(f"{tmp_path}/{k}").collect()))
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    kept = [{r.doc_id: r for r in after} for _, after in made[:4]]
    shouts = {i for i, _, good, _ in corpus(300, 2) if not good}
    found = set(range(300)) - kept[0].keys()
    assert len(found ^ shouts) <= 6

    groups = defaultdict(list)
    for r in made[1][0]:
        groups[r.text or ""].append(r.doc_id)
    assert kept[1].keys() == {max(g) for g in groups.values()}

    wanted = brute_force([(r.doc_id, r.text) for r in made[2][0]], 5, 80)
    assert kept[2].keys() == {least for _, _, least in wanted}

    for r in made[3][0]:
        after = kept[3][r.doc_id].text
        plain = r.text if r.text is None else re.sub(PATTERNS[0][1], "[secret]", r.text)
        assert after == plain and not spans(after)

    t = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    tokens = defaultdict(int)
    for r in made[4][1]:
        tokens[r.doc_id] += r.length
    assert tokens == {
        r.doc_id: len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in made[4][0]
    }

    whole = corpus_pipeline.run(spark, sf_dir).collect()
    place = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(place, whole)) == sorted(map(place, made[4][1]))


def test_mask_is_no_secret():
    assert not spans("[secret] [secret]") and secrets.BASE_RULES[0].group == 2
