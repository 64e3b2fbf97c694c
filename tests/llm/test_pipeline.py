"""The pipeline's stages against brute-force versions of what each must do to its own input."""

import os
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P

from .helpers import SCHEMA, documents, empty, prose, rows
from .test_joins import jaccard_components, kept_lines
from .test_mixing import targets


def staged(spark, df, tmp_path, upto):
    """Input and output rows of each stage, written and read again as the pipeline does."""
    out = []
    for k, (_, stage) in enumerate(P.STAGES[:upto]):
        path = str(tmp_path / str(k))
        stage(spark, df, "").write.parquet(path)
        after = spark.read.parquet(path)
        out.append((df.collect(), after.collect(), after))
        df = after
    return out


def test_stages(spark, tmp_path):
    rng = random.Random(12)
    base = [r for r in rows(5) if r[0] is not None]
    base = list({r[0]: r for r in base}.values())
    base += [(7000 + i, prose(rng, 4, 14), "en", "ab"[i % 2], 1) for i in range(120)]
    near = prose(rng, 1, 4) + "\n" + "\n".join(" ".join(prose(rng, 1, 3).split()) for _ in range(12))
    base += [(8000 + i, near.replace("\n", " x\n", i % 2), "en", "a", 1) for i in range(6)]
    got = staged(spark, spark.createDataFrame(base, SCHEMA), tmp_path, 5)

    before, after, _ = got[0]
    assert {r.doc_id for r in after} <= {r.doc_id for r in before if r.text and any(c.isalpha() for c in r.text)}
    assert len(after) >= 0.97 * sum(bool(r.text and any(c.isalpha() for c in r.text)) for r in before)
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}

    before, after, _ = got[1]
    want = kept_lines({(r.doc_id, r.text) for r in before}, 90, 5)
    assert {r.doc_id: r.text for r in after} == {r.doc_id: want[r.doc_id, r.text][0] for r in before}
    assert all(r.n_chars == len(r.text) for r in after)

    before, after, _ = got[2]
    parts = jaccard_components({r.doc_id: r.text for r in before}, 5, 80)
    assert sorted(r.doc_id for r in after) == sorted({c for _, c in parts.values()})

    before, after, _ = got[3]
    size = {}
    for r in before:
        size[r.source] = size.get(r.source, 0) + len(r.text.split())
    want, words = targets(size), {}
    longest = max(len(r.text.split()) for r in before)
    for r in after:
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    assert all(abs(words.get(s, 0) - want[s]) <= longest + 32 for s in size)
    assert {(r.doc_id, r.text) for r in after} <= {(r.doc_id, r.text) for r in before}

    before, after, _ = got[4]
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = [len(whole.encode(r.text, add_special_tokens=False).ids) + 1 for r in before]
    assert sum(r.length for r in after) == sum(lengths)
    assert len({r.sequence_id for r in after}) <= np.ceil(sum(lengths) / 4096) + 2


def test_run_is_the_stages(spark, tmp_path):
    documents(spark, 5).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = P.run(spark, str(tmp_path)).collect()
    last = staged(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), tmp_path, 5)[-1][1]
    key = lambda r: (str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, got)) == sorted(map(key, last))
    folder = P.shared_folder(spark).removeprefix("file:")
    assert os.path.isabs(folder) and not [x for x in os.listdir(folder) if x.startswith("pipeline-")]


def test_near_copies_with_repeated_rows_and_without_ids(spark):
    """The stage that keeps one document of each group, on rows as they come."""
    base = [*rows(6), *rows(6)[:9]]
    got = P.drop_near_copies(spark, spark.createDataFrame(base, SCHEMA), "").collect()
    parts = jaccard_components({r[0]: r[1] for r in base if r[0] is not None}, 5, 80)
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted({c for _, c in parts.values()})
    assert sum(r.doc_id is None for r in got) == 1


def test_lines_with_repeated_rows_and_without_ids(spark):
    base = [*rows(6), *rows(6)[:9]]
    got = P.drop_lines(spark, spark.createDataFrame(base, SCHEMA), "").collect()
    want = kept_lines({(r[0], r[1]) for r in base}, 90, 5)
    assert sorted(str((r.doc_id, r.text)) for r in got) == sorted(str((r[0], None if r[1] is None else want[r[0], r[1]][0])) for r in base)


def test_empty(spark, tmp_path):
    assert all(not after for _, after, _ in staged(spark, empty(spark), tmp_path, 5))
