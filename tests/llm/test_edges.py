"""Edge cases of the operators and the pipeline: clashing columns, empty tables, ties, repeated
rows, very long texts; fits and scans against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

WORDS = [f"w{i}" for i in range(300)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n))


def test_vectors_with_clashing_columns_and_extreme_norms(spark):
    from loomgraph.llm.embedding_dedup import near_vectors

    vectors = [[1e200, 1e200], [2e200, 2e200], [1.0, 1.0], [1e-200, 1e-200], [1.0, -1.0], [0.0, 0.0], None, [1.0, 1.0]]
    data = [(i, v, 1, 7, 8, "x", 9.0) for i, v in enumerate(vectors)] + [(2, vectors[2], 1, 7, 8, "x", 9.0), (None, [1.0, 1.0], 1, 7, 8, "x", 9.0)]
    rows = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int, g long, rep long, component string, n double")
    got = [tuple(r) for r in near_vectors(rows).collect()]
    assert len(got) == len(data) and got.count((2, 4, 0, False)) == 2
    known = {r[0]: r[1:] for r in got}
    assert all(known[i] == (4, 0, i == 0) for i in (0, 1, 2, 3, 7))
    assert known[4] == (0, 4, True) and known[5] == (0, 5, True) and known[6] == (0, 6, True) and known[None] == (0, None, False)


def test_binary_codes_with_clashing_columns(spark):
    from loomgraph.llm.binary_topk import codes, top_k

    data = [(i, [float(i % 3 - 1), 1.0, -1.0], 5, b"x", 6) for i in range(9)]
    base = codes(spark.createDataFrame(data, "vec_id long, embedding array<double>, dim int, code binary, id long"), "vec_id", "embedding")
    assert base.columns == ["id", "dim", "code"]
    got = sorted((r.query_id, r["rank"], r.id, r.distance) for r in top_k(base, base.where("id = 0"), 20).collect())
    bits = [x > 0 for i in range(9) for x in [i % 3 - 1]]
    want = sorted((int(bits[i] != bits[0]), i) for i in range(1, 9))
    assert got == [(0, k + 1, i, d) for k, (d, i) in enumerate(want)]


def test_sentence_piece_is_the_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    from loomgraph.llm.sentence_piece import Model

    path = P.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    model = Model(open(path, "rb").read())
    assert all(model.whole[i] for i in model.ids.values())
    r = random.Random(5)
    pieces = [p.replace("▁", " ") for p in model.ids]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(1, 6))) for _ in range(5000)]
    texts += ["".join(r.choice("aabbcé  \n\t.,'日🎉ſx1") for _ in range(r.randint(0, 40))) for _ in range(5000)]
    texts += ["", "a" * 3000, "é" * 60 + "," * 70, " ".join(["again"] * 4000)]
    for _ in range(2):  # the second time from the memo
        assert model.encode(texts) == [np.array(x, "<u4").tobytes() for x in library.encode(texts)]
    # the pairs of pieces that may stand side by side, by encoding their concatenation
    some = np.array(r.sample([i for i in model.ids.values()], 400))
    a, b = some[:200], some[200:]
    alone = [model.long_merge((model.pieces[x][0] + model.pieces[y][0])) for x, y in zip(a, b, strict=True)]
    assert model.can_follow(a, b).tolist() == [x == np.array([i, j], "<u4").tobytes() for x, i, j in zip(alone, a, b, strict=True)]


def test_sentence_piece_of_tables(spark):
    pytest.importorskip("sentencepiece")
    from loomgraph.llm.sentence_piece import decode, digests, encode

    path = P.path("piece_bpe_32k.model")
    names = "doc_id long, text string, ids string, n_tokens string"
    rows = spark.createDataFrame([(1, "one two", "x", "y"), (1, "one two", "x", "y"), (None, "three", "x", "y"), (2, None, "x", "y"), (3, "long " * 30_000, "x", "y")], names)
    assert sorted(((r.doc_id, r.text) for r in decode(encode(rows, path), path).collect()), key=repr) == sorted([(1, "one two"), (1, "one two"), (None, "three"), (2, ""), (3, "long " * 30_000)], key=repr)
    empty = spark.createDataFrame([], names)
    assert digests(empty, path).count() == 0 and decode(encode(empty, path), path).count() == 0


def test_line_dedup_of_repeated_rows_and_long_texts(spark):
    from loomgraph.llm.line_dedup import line_dedup

    own = "\n".join(f"line {i}" for i in range(20_000))
    data = [(i, f"{own}\nshared here\nshared here", f"s{i}", 1, "a", "b") for i in range(10)]
    data += [data[0], (50, "shared here", "s1", 1, "a", "b"), (51, "x" * 300_000, "s2", 1, "a", "b")]
    names = "doc_id long, text string, source string, line_dedup int, line string, h string"
    out = line_dedup(spark.createDataFrame(data, names).repartition(4), 10)
    got = sorted((r.doc_id, len(r.text), r.line_dedup.n_lines, r.line_dedup.n_removed, r.line, r.h) for r in out.collect())
    # the lines of ``own`` are on ten sites as well
    assert got == sorted([(i, 0, 20_002, 20_002, "a", "b") for i in range(10)] + [(0, 0, 20_002, 20_002, "a", "b"), (50, 0, 1, 1, "a", "b"), (51, 300_000, 1, 0, "a", "b")])
    assert line_dedup(spark.createDataFrame(data, names), 11).where("line_dedup.n_removed > 0").count() == 0


def test_toxicity_fit_is_the_definition(spark):
    """Lexicon and scores against the formulas over plain word counts."""
    from loomgraph.llm import toxicity as t

    rng = np.random.default_rng(31)
    docs, labels = [], []
    for i in range(1200):
        w = prose(rng, 40).split()
        if i % 5 == 0:
            w[3], w[9] = "vile", rng.choice(["awful", "grim"])
        docs.append((i, " ".join(w)))
        labels.append((i, int(i % 5 == 0)))
    model = t.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    train = [(set(re.findall("[a-z]+", d)), y) for (i, d), (_, y) in zip(docs, labels, strict=True) if zlib.crc32(str(i).encode()) % 3 != 1]
    n_bad, n_all = sum(y for _, y in train), len(train)
    every = [set(re.findall("[a-z]+", d)) for _, d in docs]
    want = []
    for word in set().union(*every):
        bad, n = sum(word in s and y for s, y in train), sum(word in s for s, _ in train)
        if bad < 3 or bad * n_all <= n * n_bad:
            continue
        alpha = t.PRIOR * (sum(word in s for s in every) + 0.5) / (len(every) + 1)

        def odds(y, m, alpha=alpha):
            return math.log(y + alpha) - math.log(m + t.PRIOR - y - alpha)

        delta = odds(bad, n_bad) - odds(n - bad, n_all - n_bad)
        if t._root_ratio(np.array([bad]), n_bad, np.array([n - bad]), n_all - n_bad)[0] >= t.LEAST_ROOT and delta >= t.LEAST_ODDS:
            want.append(min(delta, t.MOST))
    assert len(want) >= 2 and np.allclose(sorted(model.scores), sorted(want))


def test_license_scan_against_full_alignment(spark):
    """All templates aligned with small whole texts; ties, repeated rows, long texts, null ids."""
    from loomgraph.llm.hashing import words
    from loomgraph.llm.license_scan import GAPS, Templates, align, license_scan
    from loomgraph.llm.license_templates import TEMPLATES

    rng = np.random.default_rng(41)
    t = Templates()
    texts = []
    for _, _, text in TEMPLATES:
        w = text.split()
        for share in (0.02, 0.1, 0.3):
            texts.append(" ".join(x if rng.random() > share else str(rng.choice(WORDS)) for x in w))
    found = {}
    for i, text in enumerate(texts):
        raw = np.frombuffer(text.encode(), np.uint8)
        h, *_ = words(raw, np.array([0, len(raw)]), gaps=GAPS)
        runs = {tuple(h[k : k + 3]) for k in range(len(h) - 2)}
        # what no run of three words has in common with a template has no fingerprint in common either
        best = max((m for b in t.words if runs & {tuple(b[k : k + 3]) for k in range(len(b) - 2)} and (m := align(h, b)[0]) >= 0.75 * len(b)), default=None)
        if best:
            found[i] = best
    long = prose(rng, 30_000)
    names = "doc_id long, text string, template string, coverage string"
    data = [(i, x, "a", "b") for i, x in enumerate(texts)] + [(0, texts[0], "a", "b"), (None, texts[0], "a", "b"), (900, long + " " + texts[0] + " " + long, "a", "b"), (901, "", "a", "b")]
    got = license_scan(spark.createDataFrame(data, names)).collect()
    best = {}
    for r in got:
        best[r.doc_id] = max(best.get(r.doc_id, 0), r.matched)
    assert {k: v for k, v in best.items() if k is not None and k < 900} == found
    assert best[900] == best[None] == found[0] and 901 not in best
    assert len([r for r in got if r.doc_id == 0]) == 2 * len([r for r in got if r.doc_id is None])


def _tables(spark, path, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_pipeline_of_empty_tables_and_nulls(spark, tmp_path):
    import corpus_pipeline

    _tables(spark, tmp_path / "a", [], [])
    assert corpus_pipeline.run(spark, str(tmp_path / "a")).count() == 0
    _tables(spark, tmp_path / "b", [(None, None, None, None, None), (None, None, None, None, None), (1, None, None, None, None), (2, "", None, None, 0)], [(None, None, None), (1, None, 1)])
    got = corpus_pipeline.run(spark, str(tmp_path / "b")).collect()
    assert sorted((r.doc_id, r.length) for r in got if r.doc_id is not None) == [(1, 1), (2, 1)]
    assert [r.length for r in got if r.doc_id is None] == [1]


def test_pipeline_from_end_to_end(spark, tmp_path):
    """The whole run against plain Python for each stage but the learned scores."""
    import corpus_pipeline

    rng = np.random.default_rng(51)
    docs, labels = [], []
    for i in range(400):
        w = prose(rng, 60).split()
        if i % 8 == 0:
            for k in (5, 20, 40):
                w[k] = str(rng.choice(["vile", "awful", "nasty"]))
        docs.append([i, " ".join(w), "en", f"s{i % 12}", 0])
        labels.append((i, 1, int(i % 8 == 0)))
    passage = prose(rng, 40)
    for i in range(1, 61, 4):
        docs[i][1] += "\nread the terms of use"  # on many sites
    for i in (3, 7, 11):
        docs[i][1] = docs[i][1] + " " + passage
    for i in (101, 102):
        docs[i][1] = docs[99][1] + " end"
    docs = [(a, b, c, d, len(b)) for a, b, c, d, _ in docs]
    _tables(spark, tmp_path, docs, labels)
    clean = [(a, b, d) for a, b, _, d, _ in docs if a % 8]
    sites = {}
    for _, b, d in clean:
        for line in b.split("\n"):
            sites.setdefault(line.strip(), set()).add(d)
    lines = [(a, "\n".join(x for x in b.split("\n") if not x.strip() or len(sites[x.strip()]) < 10)) for a, b, _ in clean]
    sets = {a: {tuple(b.split()[i : i + 5]) for i in range(len(b.split()) - 4)} for a, b in lines}
    kept = [(a, b) for a, b in lines if not any(c < a and 100 * len(sets[a] & sets[c]) >= 75 * len(sets[a] | sets[c]) for c in sets)]
    seen, left = set(), []
    for a, b in kept:
        raw, gone = b.encode(), bytearray(len(b.encode()))
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(raw[s : s + 100])
        left.append((a, bytes(x for x, g in zip(raw, gone, strict=True) if not g).decode()))
    library = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = sorted((a, 0, 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for a, b in left for ids in [[*library.encode(b, add_special_tokens=False).ids, 2]])
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert 99 in {a for a, _ in left} and not {101, 102} & {a for a, _ in left} and hashlib.md5(passage.encode())
    places = pd.DataFrame([(r.sequence_id, r.offset, r.length) for r in rows], columns=["s", "o", "n"]).sort_values(["s", "o"])
    assert (places["o"] == places.groupby("s")["n"].cumsum() - places["n"]).all() and places.groupby("s")["n"].sum().max() <= 1024
