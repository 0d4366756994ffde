"""The five stages against brute force over a small corpus."""

import base64
import re
from collections import Counter, defaultdict
from math import log2

import sentencepiece
import tiktoken

import corpus_pipeline
from botsift.llm.quality import BANDS, BYTE_LEVEL, ENTROPY_TOKENS, PIECES, VOCABULARIES, WORD_PATTERN, script_of
from botsift.session import scratch_path

from . import test_decontam, test_mixing_sharding, test_neardup, test_quality
from .conftest import DOCS


def kept_by_quality(text, lang):
    n, chars, _, _, repeat = test_quality.brute(text)
    if n < 20 or 100 * repeat > 30 * n:
        return False
    sp = sentencepiece.SentencePieceProcessor(model_file=f"{VOCABULARIES}/{PIECES}")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{VOCABULARIES}/{BYTE_LEVEL}", "rb"))}
    level = tiktoken.Encoding("test", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = test_quality.words(text)
    ids = Counter(sp.encode(" ".join(words)))
    pieces = sum(ids.values())
    entropy = -sum(v / pieces * log2(v / pieces) for v in ids.values())
    b = BANDS.get(lang) or BANDS[script_of(text)]
    return (b[0] <= chars / pieces <= b[1] and b[2] <= chars / sum(len(level.encode_ordinary(" " + w)) for w in words) <= b[3]
            and sum(v for k, v in ids.items() if sp.is_byte(k)) / pieces <= b[4]
            and entropy / log2(min(pieces, ENTROPY_TOKENS)) >= b[5])


def brute(rows, items):
    rows = [r for r in rows if kept_by_quality(r[1] or "", r[2])]
    rows = test_neardup.kept_rows(rows, 5)
    rows = [r for r, b in zip(rows, test_decontam.brute(rows, items)) if not b[-1]]
    t = test_mixing_sharding.brute_targets(rows)
    out = Counter()
    for r in rows:
        rate = t[r[3]][1] / t[r[3]][0]
        out[r] += int(rate // 1 + (test_mixing_sharding.draw(r) < rate % 1))
    return +out


def prose_rows(spark, rows):
    """The corpus rows with texts of real word shapes, so that the tokeniser bands keep them."""
    syllables = "the of and tion ing er re en st in on at he an ou is it or ti as".split()

    def word(w):
        return "".join(syllables[(ord(c) * 7 + i) % len(syllables)] for i, c in enumerate(w[:3])) if w.isalpha() and w.isascii() else w

    return [(r[0], re.sub(r"[^\s.]+", lambda m: word(m[0]), r[1]) if r[1] else r[1], *r[2:]) for r in rows]


def test_run_matches_brute_force(spark, rows):
    rows = prose_rows(spark, rows)
    items = test_decontam.items_of(rows)[:3] + [(11, " ".join(test_decontam.words(rows[30][1])[:14]), "x")]
    sf_dir = scratch_path(spark, "pipeline-test")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame(items, test_decontam.ITEMS).write.parquet(f"{sf_dir}/benchmark.parquet")
    out = corpus_pipeline.run(spark, sf_dir).collect()
    got = Counter((r["doc_id"], r["text"], r["lang"], r["source"]) for r in out)
    want = Counter()
    for k, v in brute(rows, items).items():
        want[k[:4]] += v
    assert 20 < len(want) < len(rows)
    assert got == want
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_stages_return_the_columns_of_documents(spark, docs, rows):
    sf_dir = scratch_path(spark, "pipeline-test")
    spark.createDataFrame(test_decontam.items_of(rows), test_decontam.ITEMS).write.parquet(f"{sf_dir}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for d in (docs, docs.limit(0)):
            out = stage(spark, d, sf_dir)
            if name == "vector_sharding":
                assert set(out.columns) == {*d.columns, "size", "text_crc32", "shard", "slot"}
            else:
                assert out.columns == d.columns
            if d is not docs:
                assert out.count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "minhash_neardup", "benchmark_decontamination", "source_mixing", "vector_sharding"]
