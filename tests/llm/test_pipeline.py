"""The stages of corpus_pipeline.py, each against a plain version of its decision."""

import hashlib
import math
from collections import Counter

import pytest

import corpus_pipeline
from loxodrome.llm import langid, mixing
from tests.llm.plain import contamination, near_groups
from tests.llm.test_pii import plain_entities

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out, root = [docs], tmp_path_factory.mktemp("stages")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(root / str(i))
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns(stages):
    for df in stages[1:-1]:
        assert df.columns == corpus_pipeline.COLUMNS
    assert {"doc_id", "copy", "shuffle_key"} <= set(stages[-1].columns)


def test_language_keeps_what_can_be_told(stages):
    """The decisions of the network that the stage learns, text by text; nothing else goes."""
    before, after = rows(stages[0]), rows(stages[1])
    net = langid.learnt(stages[0])
    ids = sorted(before)
    langs, scores = langid.predictor(net)()([(before[d]["text"] or "").encode() for d in ids])
    least = corpus_pipeline.LEAST_TIMES / len(net.langs)
    assert set(after) == {d for d, lang, s in zip(ids, langs, scores, strict=True) if lang != langid.UNKNOWN and s >= least} and len(after) > 0.97 * len(before)
    assert all(after[d] == before[d] for d in after)


def test_one_of_each_group_stays(stages):
    before, after = rows(stages[1]), rows(stages[2])
    groups = near_groups([(d, r["text"]) for d, r in before.items()], 5, 80)
    assert set(after) == {d for d, (_, root) in groups.items() if d == root}


def test_contaminated_documents_go(stages, spark):
    before, after = rows(stages[2]), rows(stages[3])
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    found = contamination([(d, r["text"]) for d, r in before.items()], items)
    assert set(after) == {d for d, (_, hit, _) in found.items() if not hit}


def test_private_data_is_replaced(stages):
    """Rows change where an engine of its own finds entities, and there only; no entity stays."""
    before, after = rows(stages[3]), rows(stages[4])
    assert set(before) == set(after) and all(r["n_chars"] == len(r["text"]) for r in after.values())
    for d, r in before.items():
        found = [e for _, e in plain_entities(r["text"])]
        assert (after[d]["text"] != r["text"]) == bool(found) and after[d]["lang"] == r["lang"]
        assert not any(e in after[d]["text"] for e in found)


def plain_copies(docs):
    """doc_id -> copies by the inverse of Poisson's distribution at a hashed number, with rates from the sources' sizes."""
    n = Counter(r["source"] for r in docs.values())
    total = sum(c**mixing.TEMPERATURE for c in n.values())
    out = {}
    for d, r in docs.items():
        rate = len(docs) * (n[r["source"]] ** mixing.TEMPERATURE / total) / n[r["source"]]
        u = int(hashlib.md5(f"{mixing.SEED}|{d}".encode()).hexdigest()[: mixing.DIGITS], 16) / 16**mixing.DIGITS
        p = cdf = math.exp(-rate)
        k = 0
        while cdf <= u:
            k += 1
            p *= rate / k
            cdf += p
        out[d] = k
    return out


def test_mixture(stages, spark):
    """The copies of each document, and their order by the hashed key."""
    before, got = rows(stages[4]), stages[5].collect()
    assert Counter(r["doc_id"] for r in got) == Counter({d: k for d, k in plain_copies(before).items() if k})
    assert all(r["shuffle_key"] == int(hashlib.md5(f"{mixing.SEED + 1}|{r['doc_id']}|{r['copy']}".encode()).hexdigest()[: mixing.DIGITS], 16) and r["text"] == before[r["doc_id"]]["text"] for r in got)
    # each partition holds a range of the key, in order
    made = corpus_pipeline.run(spark, SF).select("doc_id", "shuffle_key").collect()
    assert [r["shuffle_key"] for r in made] == sorted(r["shuffle_key"] for r in got) and Counter(r["doc_id"] for r in made) == Counter(r["doc_id"] for r in got)
