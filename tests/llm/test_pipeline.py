import hashlib
import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from doctree.llm import bpe, pii
from doctree.sources import scratch


def test_pipeline_equals_its_plain_form(spark, tmp_path):
    """Junk, near copies, contaminated texts and personal data, one planted kind at a time, over all stages."""
    import public_tokenizers as P
    import tiktoken

    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "eta", "zeta", "theta", "iota", "kappa", "mu"]
    prose = lambda n: " ".join(rng.choice(words).capitalize() if i % 9 == 0 else rng.choice(words) + str() for i in range(n)) + "."
    item = " ".join(f"bench{i}" for i in range(14))
    rows, labels = [], []
    for i in range(120):
        junk = i % 4 == 3
        rows.append((i, " ".join(rng.choice(words).upper() + "!!" for _ in range(60)) if junk else prose(60 + i % 7)))
        if i < 100:
            labels.append((i, int(not junk), 0))
    copy = rows[1][1] + " " + prose(300)
    rows += [(200, copy), (201, copy + " mu mu"), (202, copy), (203, prose(50) + " " + item), (204, prose(40) + " write to a.b@c.org now")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    sf = f"file://{tmp_path}"
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == {i for i in range(120) if i % 4 != 3} | {200, 204}
    ranks = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, r in got.items():
        text = re.sub(r"a\.b@c\.org", "<email>", dict(rows)[i])
        ids = reference.encode_ordinary(text)
        assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_stages_keep_columns_and_clean_rows(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
    assert pii.mask(docs).count() == docs.count()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_stages_on_odd_rows(spark):
    """Null ids and texts, empty texts, repeated rows, very long texts and columns named like results, through every stage."""
    sf = "/root/testdata/sf0.001"
    good = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1"), "doc_id").orderBy("doc_id").first().text
    rows = [(None, good), (None, None), (900001, None), (900002, ""), (900003, good + " x y z"), (900003, good + " x y z"), (900004, " \n"), (900005, good.replace(" ", "  ") * 40), (900006, "word " * 200_000), (900007, "w" * 300_000)]
    odd = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    clash = {c: F.lit("mine") for c in ("score", "n_hit", "hit_spans", "root", "node", "text_key", "spans", "_id", "_key", "_spans", "_reach", "_many", "token_ids", "n_tokens")}
    odd = odd.withColumns(clash)
    columns = odd.columns
    texts = lambda df: sorted(str((r.doc_id, r.text)) for r in df.select("doc_id", "text").collect())
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, sf)
        assert out.columns == columns and out.filter("root <> 'mine' or n_hit <> 'mine'").count() == 0
        kept[name] = texts(out)
    everything = texts(odd)
    assert kept["decontamination"] == everything and kept["pii"] == everything
    assert set(kept["quality"]) <= set(everything) and str((None, good)) in kept["quality"]
    near = kept["near_copies"]
    assert sum(str((900003, good + " x y z")) == t for t in near) == 1 and str((None, good)) not in near
    assert {str((None, None)), str((900001, None)), str((900002, "")), str((900004, " \n"))} <= set(near)
    last = corpus_pipeline.STAGES[-1][1](spark, odd, sf).collect()
    assert len(last) == len(rows) and {r.n_tokens for r in last if r.doc_id in (900001, 900002)} == {0}


def test_pipeline_leaves_its_result_only(spark, tmp_path, monkeypatch):
    for module in (corpus_pipeline, scratch):
        monkeypatch.setattr(module, "shared_dir", lambda spark: f"file://{tmp_path}/shared")
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count()
    left = [p.name for p in (tmp_path / "shared").iterdir() if not p.name.startswith(".")]
    assert len(left) == 1 and left[0].endswith("-" + corpus_pipeline.STAGES[-1][0])
