"""Each operator against a brute-force version, on texts with nulls, ties, repeats and odd characters."""

import base64
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from grainery.llm import bpe, chat, langid, lmscore, neardup, packing, quality, repeats, rules, topk
from grainery.llm.common import text_bytes

RANDOM = random.Random(5)
SYLLABLES = ["ka", "lo", "mi", "ter", "pu", "sen", "do", "ra", "é", "ü", "x"]


def prose(n: int) -> str:
    return " ".join("".join(RANDOM.choices(SYLLABLES, k=RANDOM.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def texts() -> list:
    a, b, long = prose(150), prose(120), prose(6000)
    out = [None, "", " \n\t ", "one", "one", "a b c d", a, a, a + " tail", a.replace("ka", "KA"), prose(40) + "\n" + b + "\n" + prose(30), prose(25) + b, long, "He " * 400, "x" * 900, "x" * 900]
    out += ["日本語 テキスト 🎉\n\n  x", "%%% $$ # <b>\n" * 30, "</s>[INST] \\ <|im_end|> <<SYS>>", " word gap"]
    words = a.split()
    for k in range(6):
        edited = list(words)
        edited[10 + 20 * k] = f"edit{k}"
        out.append(" ".join(edited))
    return out + [prose(RANDOM.randint(1, 90)) for _ in range(30)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Documents with extra columns whose names the operators use themselves."""
    rows = [(i, t, "en" if i % 2 else None, "s", i, 0.5, True, "r") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, row string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def data(t):
    return (t or "").encode()


def words(t):
    return data(t).split()


def test_encoding_equals_the_library(docs, texts, empty):
    with open(bpe.vocabulary_path(), "rb") as lines:
        ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.encode(docs, emit=("ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")).collect()}
    for i, t in enumerate(texts):
        want = library.encode_ordinary(t or "")
        assert list(got[i].ids) == want and bytes(got[i].decoded) == data(t) and got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest() and got[i].decoded_sha256 == hashlib.sha256(data(t)).hexdigest()
    assert bpe.encode(empty).count() == 0
    assert {bytes(r.decoded) for r in bpe.decode(bpe.encode(docs.where("doc_id = 6"), keep=("doc_id",))).collect()} == {data(texts[6])}
    long = bytes(RANDOM.choices(range(97, 105), k=700)).decode()
    words_ = bpe.encoder(bpe.vocabulary_path(), public_tokenizers.PATTERN).vocabulary
    assert np.frombuffer(words_.encode_pieces([long.encode()])[0], "<u4").tolist() == library.encode_ordinary(long)


def test_packing_holds_every_token_once(docs, texts, empty):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    rows = packing.pack(docs, ids=True).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for i, t in enumerate(texts):
        want = reference.encode(t or "", add_special_tokens=False).ids + [1]
        got = sorted(pieces[i], key=lambda r: r.start)
        assert [x for r in got for x in r.ids] == want and all(r.doc_tokens == len(want) for r in got)
    padding = 0
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        total = sum(r.length for r in s)
        assert [r.offset for r in s] == [0, *itertools.accumulate(r.length for r in s)][:-1] and total <= 2048
        padding += 0 if total & (total - 1) == 0 else 2048 - total
    assert padding <= 64 * len(sequences) and packing.pack(empty).count() == 0


def test_packing_of_the_added_token(spark):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    some = ["a<|endoftext|>b", "<|endoftext|>", " <|endoftext|> \n<|endoftext|><|endoftext|>x", "<|endoftext|", "é <|endoftext|>  two", "<|ENDOFTEXT|>"]
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    for i, t in enumerate(some):
        want = reference.encode(t, add_special_tokens=False).ids + [1]
        got = sorted(packing.pack(df.where(F.col("doc_id") == i), ids=True).collect(), key=lambda r: r.start)
        assert [x for r in got for x in r.ids] == want and all(r.doc_tokens == len(want) for r in got)


@pytest.mark.parametrize("sizes", [[], [1], [2048], [2049, 5000], [1500, 600, 500, 40, 40], [RANDOM.randint(1, 3000) for _ in range(400)]])
def test_packing_plan(sizes):
    seen = defaultdict(list)
    for sequence in packing.plan(sizes):
        assert 0 < sum(n for *_, n in sequence) <= 2048
        for d, start, n in sequence:
            seen[d].append((start, n))
    for d, size in enumerate(sizes):
        at = 0
        for start, n in sorted(seen[d]):
            assert start == at
            at += n
        assert at == size


def test_packing_takes_the_tightest_window():
    tree, windows = packing.OpenWindows(64), []
    for k in range(300):
        if k % 3 == 2 and windows:
            least = RANDOM.randint(1, 64)
            fits = [c for c in windows if c >= least]
            got = tree.take(least)
            assert (got[0] if got else None) == (min(fits) if fits else None)
            if got:
                windows.remove(got[0])
        else:
            windows.append(RANDOM.randint(1, 64))
            tree.add(windows[-1], k)


def test_topk_equals_all_products(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8).astype(np.float32)]) for i in range(300)]
    rows += [(300, rows[0][1]), (301, None), (302, [1.0, None]), (303, [float("nan")] * 8), (304, [float("inf")]), (305, []), (306, [0.5] * 3), (307, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(5)
    got = topk.search(df, df.where("vec_id % 20 = 0"), k=20, block_rows=(64, 8)).collect()
    ok = {i: np.pad(np.floor(64 * np.array(v, np.float64)), (0, 8 - len(v))) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in sorted(ok):
        if q % 20 == 0:
            best = sorted((-int(ok[q] @ ok[c]), c) for c in ok if c != q)[:20]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)
    assert topk.search(df.where("false"), df, k=3).count() == 0 and topk.search(df.limit(1), df.limit(1), k=3).count() == 0


def test_topk_of_large_components_and_repeated_queries(spark):
    """Finite components of any size take part; equal query rows are one query, and different vectors under one id are two."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 4)]) for i in range(80)]
    rows[3] = (3, [4e7, -3.7, 2.0, 0.5])
    rows[4] = (4, [4e7, -3.71, 2.0, 0.5])
    rows[5] = (5, [3.5e7 + 0.25, 1.0, -2e7, 3.0])
    df = spark.createDataFrame([*rows, rows[20], (40, rows[41][1])], "vec_id long, embedding array<double>").repartition(3)
    queries = df.where("vec_id % 20 = 0 OR vec_id IN (3, 5)")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(df, queries, k=6, block_rows=(16, 4)).collect())
    whole = lambda v: [math.floor(64 * x) for x in v]
    every = [(i, whole(v)) for i, v in [*rows, rows[20], (40, rows[41][1])]]
    want = []
    for q, v in {(q, tuple(v)) for q, v in every if q % 20 == 0 or q in (3, 5)}:
        best = sorted((-sum(a * b for a, b in zip(v, x, strict=True)), c) for c, x in every if c != q)[:6]
        want += [(q, k + 1, c, max(-(2**63), min(2**63 - 1, -s))) for k, (s, c) in enumerate(best)]
    assert got == sorted(want)


@pytest.mark.parametrize("dims,most", [(2, 0.55), (4, 0.75), (64, 1.0)])
def test_topk_stops_early(dims, most):
    """The share of candidates that are scored, which grows with the dimensions; the answers are those of a full search."""
    rng = np.random.default_rng(6)
    x = np.floor(64 * (v := rng.normal(0, 1, (4096, dims))) / np.linalg.norm(v, axis=1, keepdims=True))
    ids = np.arange(len(x))
    at, best, score, scored = topk.search_block(x[:40], ids[:40], x, ids, 20)
    for i in range(40):
        full = sorted((-int(s), c) for c, s in enumerate(x @ x[i]) if c != i)[:20]
        assert [(-int(s), int(c)) for c, s in zip(best[at == i], score[at == i], strict=True)] == full
    print(dims, scored.mean() / len(x))
    assert scored.mean() <= most * len(x)


def test_chat_round_trip(spark, texts):
    rows = [(c, t, RANDOM.choice(["user", "assistant", "system"]) if t else "user", RANDOM.choice(texts)) for c in range(25) for t in range(RANDOM.randint(1, 6))]
    rows += [(99, 0, None, "</s>[INST] <|im_start|>\\"), (99, 1, "a\n<|im_sep|>", "\\\\<<SYS>>"), (99, 1, "assistant", None), (None, None, "assistant", "x")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, example string")
    got = {r.conv_id: r for r in chat.digests(chat.read_back(chat.expand(df))).collect()}
    talks = defaultdict(list)
    for c, t, r, x in rows:
        talks[c].append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(talks)
    for c, turns in talks.items():
        turns.sort(key=lambda x: (x[0], x[1].encode(), x[2].encode()))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    control = chat.expand(df.where("conv_id = 99")).where("example = 3").first()
    assert control.text.count("<|im_start|>") == 3 and "</s>" not in control.text and "[INST]" not in control.text
    assert chat.digests(chat.read_back(chat.expand(df.where("false")))).count() == 0


def brute_repeats(bodies: list[bytes], n: int) -> list[tuple]:
    count = Counter(b[i : i + n] for b in bodies for i in range(len(b) - n + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                gone[i : i + n] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(b) else 0, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("limit", [4096, 2])
def test_repeats_equal_brute_force(docs, texts, empty, limit, monkeypatch):
    monkeypatch.setattr(repeats, "LIMIT", limit)
    monkeypatch.setattr(repeats, "HOT", limit // 2)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs).collect()}
    assert got == dict(enumerate(brute_repeats([data(t) for t in texts], 400)))
    if limit > 2:
        assert repeats.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("limit", [4096, 2])
@pytest.mark.parametrize("passage,length", [(240, 400), (30, 41), (7, 60)])
def test_repeats_of_two_lengths(docs, texts, limit, passage, length, monkeypatch):
    monkeypatch.setattr(repeats, "LIMIT", limit)
    got = {r.doc_id: ((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256), r.n_passage_bytes) for r in repeats.remove_repeats(docs, length=length, passage=passage).collect()}
    bodies = [data(t) for t in texts]
    for i, (long, short) in enumerate(zip(brute_repeats(bodies, length), brute_repeats(bodies, passage), strict=True)):
        assert got[i] == (long, short[1])


def test_repeats_in_segments(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PASS_BYTES", 1000)
    a, b = prose(400), prose(300)
    some = [a + b + prose(900), prose(200) + b[5:] + prose(500) + a[: len(a) // 2], prose(60), a[100:]]
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    got = {r.doc_id: ((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256), r.n_passage_bytes) for r in repeats.remove_repeats(df, passage=90).collect()}
    bodies = [data(t) for t in some]
    assert got == dict(enumerate(zip(brute_repeats(bodies, 400), [x[1] for x in brute_repeats(bodies, 90)], strict=True)))


def test_refinement_follows_pointers():
    assert repeats.ladder((400,)) == [25, 50, 100, 200, 400] and repeats.ladder((240, 400)) == [30, 60, 120, 240, 400] and repeats.ladder((7, 60)) == [7, 14, 28, 56, 60]
    body = bytes(RANDOM.choices(b"ab", k=3000))
    rows = [(0, k, 0, 0, 1000 - 24, 1, body[1000 * k : 1000 * k + 1000]) for k in range(3)]
    got = {(int(d), s, int(n)) for d, _, a, z, n in zip(*repeats._refine(rows, (12, 24)), strict=True) for s in range(a, z + 1)}
    for n in (12, 24):
        count = Counter(r[6][s : s + n] for r in rows for s in range(977))
        assert {(d, s) for d, s, m in got if m == n} == {(r[1], s) for r in rows for s in range(977) if count[r[6][s : s + n]] > 1}


def test_repeats_of_null_ids_and_repeated_rows(spark, texts):
    df = spark.createDataFrame([(None, texts[6]), (None, texts[6]), (1, prose(200)), (1, prose(200))], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.n_removed == r.n_bytes) for r in repeats.remove_repeats(df).collect())
    assert got == [(False, False), (False, False), (True, True), (True, True)]


def test_neardup_equals_brute_force(docs, texts, empty):
    got = {r.doc_id: r for r in neardup.near_duplicates(docs).collect()}
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = []
    for t in texts:
        w = [x.translate(lower) for x in words(t)]
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    root = list(range(len(sets)))
    for _ in sets:
        for a, b in itertools.combinations(range(len(sets)), 2):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 85 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    for i in range(len(texts)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), root[i], root[i] == i)
    assert neardup.near_duplicates(empty).count() == 0


def test_neardup_at_another_threshold_and_without_ids(spark):
    assert (neardup.halves_at(85), neardup.halves_at(80)) == (10, 13)
    w = prose(204).split()
    near = " ".join(w[:100] + ["new", "words", "here"] + w[103:])
    far = " ".join(w[:40] + ["new", "words", "here"] * 7 + w[61:])
    shingles = [{tuple(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in (" ".join(w), near, far)]
    share = [len(shingles[0] & x) / len(shingles[0] | x) for x in shingles[1:]]
    assert share[0] >= 0.85 > 0.80 <= share[1] < 0.85
    df = spark.createDataFrame([(1, " ".join(w)), (None, near), (None, near), (3, far), (None, prose(30))], "doc_id long, text string")
    for percent, reached in ((85, 3), (80, 1)):
        got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in neardup.near_duplicates(df, percent=percent).collect())
        assert got == [(0, 0, True), (0, 1, False), (0, 1, False), (1, 1, True), (3, reached, reached == 3)]


def test_neardup_blocks_and_null_ids(docs, texts, spark, monkeypatch):
    whole = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    monkeypatch.setattr(neardup, "BLOCK", 2)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()} == whole
    df = spark.createDataFrame([(None, texts[6]), (7, texts[6]), (None, None), (None, "other words here")], "doc_id long, text string")
    assert sorted(str(r.component_id) for r in neardup.near_duplicates(df).collect()) == ["7", "7", "None", "None"]


def test_rules_counts(docs, texts, empty):
    got = {r.doc_id: r for r in rules.judge(docs, np.zeros(rules.N_WEIGHTS + 6)).collect()}
    for i, t in enumerate(texts):
        w, t = words(t), t or ""
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeated = {k + d for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for d in range(3)}
        lines, dup = [x for x in t.split("\n") if x.encode().split()], 0
        for k, line in enumerate(lines):
            dup += line in lines[:k]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), dup, len(repeated))
        assert r.base_failed == (len(w) < 50 or 100 * len(repeated) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert rules.judge(empty, np.zeros(rules.N_WEIGHTS + 6)).count() == 0


def test_viterbi_equals_all_labellings():
    rng = np.random.default_rng(1)
    field = rules.Field(rng.normal(0, 1, rules.N_WEIGHTS + 6))
    lengths = [3, 0, 1, 6, 4]
    at = np.cumsum([0, *lengths])
    bins = np.stack([rng.integers(0, len(e) + 1, at[-1]) for e in rules.EDGES], 1).astype(np.uint8)
    score, got = field.scores(bins), field.viterbi(bins, at)
    for a, b in zip(at[:-1], at[1:], strict=True):
        def value(y, a=a):
            return field.start[y[0]] + sum(score[a + k] for k in range(len(y)) if y[k]) + sum(field.move[y[k - 1], y[k]] for k in range(1, len(y)))

        if b > a:
            assert tuple(got[a:b]) == max(itertools.product((0, 1), repeat=int(b - a)), key=value)


def test_trained_models(spark):
    good = [prose(120) + ".\n" + prose(60) + "." for _ in range(60)]
    junk = ["\n".join(" ".join(w.upper() + "!!" for w in prose(30).split()) for _ in range(4)) for _ in range(60)]
    rows = [(i, t, 1) for i, t in enumerate(good)] + [(100 + i, t, 0) for i, t in enumerate(junk)]
    documents = spark.createDataFrame([(i, t, "q") for i, t, _ in rows] + [(900, None, "q"), (901, "", "q")], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if i % 2] + [(None, 1, 0), (900, None, None)], "doc_id long, quality int, toxic int")
    truth = {i: q for i, _, q in rows}
    model = quality.train(documents, labels)
    got = {r.doc_id: r for r in quality.classify(documents, model).collect()}
    assert all(got[i].predicted == q for i, q in truth.items()) and all(0 <= r.score <= 1 for r in got.values()) and len(got) == len(rows) + 2
    kept = {r.doc_id: r.kept for r in rules.judge(documents, rules.train(documents, labels)).collect()}
    assert all(kept[i] == bool(q) for i, q in truth.items()) and not kept[900]
    none = labels.where("false")
    assert quality.classify(documents, quality.train(documents, none)).count() == len(rows) + 2 and rules.train(documents, none).any() == False  # noqa: E712


def test_rules_label_lines_of_mixed_documents(spark):
    """Documents of good and junk lines: the share of content is that of the planted lines, though only documents have labels."""
    good = lambda: " ".join(prose(7).capitalize() + "." for _ in range(6))
    junk = lambda: " ".join(w + "%%%" for w in prose(30).split())
    rows, planted = [], {}
    for i in range(160):
        kinds = [1] * 8 if i % 4 == 0 else [0] * 8 if i % 4 == 1 else [1] * 6 + [0] * 2 if i % 4 == 2 else [1] + [0] * 7
        lines = [good() if k else junk() for k in kinds]
        rows.append((i, "\n".join(lines), int(sum(kinds) >= 4)))
        planted[i] = (kinds, sum(len(x) for x, k in zip(lines, kinds, strict=True) if k) / sum(map(len, lines)))
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] >= 60], "doc_id long, quality int")
    got = {r.doc_id: r for r in rules.judge(df, rules.train(df.unionByName(df), labels.unionByName(labels)), line_labels=True).collect()}
    right = sum(a == b for i, (kinds, _) in planted.items() for a, b in zip(got[i].line_labels, kinds, strict=True)) / sum(len(k) for k, _ in planted.values())
    assert right > 0.97 and all(got[r[0]].kept == bool(r[2]) for r in rows)
    mixed = [i for i in planted if i % 4 > 1]
    assert sum(0 < got[i].content_share < 1 and abs(got[i].content_share - planted[i][1]) < 0.05 for i in mixed) > 0.9 * len(mixed)
    assert rules.sample(df.unionByName(df), labels.unionByName(labels), 20).count() == 20
    assert rules.line_labels(np.array([2.0, 1.0]), np.array([5, 6]), False).tolist() == [True, False] and rules.line_labels(np.array([-2.0, -1.0]), np.array([5, 5]), True).tolist() == [False, True]


def test_language_models(spark):
    alphabets = {"aa": ["ka", "lo", "mi", "ter"], "bb": ["sch", "ein", "ung", "aus"]}
    rows = [(i, " ".join("".join(RANDOM.choices(alphabets[lang], k=3)) for _ in range(60)), lang) for i, lang in enumerate(["aa", "bb"] * 40)]
    df = spark.createDataFrame([*rows, (500, None, "aa"), (501, "123 !!", "bb"), (502, "", None)], "doc_id long, text string, lang string")
    model = langid.train(df.where("doc_id < 40 OR doc_id >= 500"))
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang in rows)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (500, 501, 502))
    # the probabilities of all symbols after a context sum to one
    symbols, _ = langid.stream(*text_bytes(__import__("pyarrow").array([rows[0][1]])))
    alphabet = np.unique(np.concatenate([langid.stream(*text_bytes(__import__("pyarrow").array([t])))[0] for _, t, lang in rows[:40]]))
    context = [int(x) for x in symbols[1:4]]
    total = np.zeros(2)
    for s in alphabet:
        key = np.array([sum(v << 16 * k for k, v in enumerate([int(s), *context[::-1]]))], np.uint64)
        lam, p = 0.0, None
        for n in range(4, 0, -1):
            row = model.grams[n - 1].find(key & np.uint64((1 << 16 * n) - 1))[0]
            if row >= 0:
                p = lam + model.grams[n - 1].rows[row]
                break
            lam = lam + model.contexts[n - 2].rows[model.contexts[n - 2].find((key & np.uint64((1 << 16 * n) - 1)) >> np.uint64(16))[0]]
        total += np.exp(p)
    assert np.all((total > 0.97) & (total < 1.001))


def brute_kneser_ney(training: dict, text: str, d: float = langid.DISCOUNT) -> dict:
    """Loss per character in every language, by dictionaries and recursion over strings."""
    fold = lambda t: " " + "".join(ch.lower() if ch.isalpha() else " " for ch in t)
    squeeze = lambda t: re.sub(" +", " ", fold(t))
    alphabet = {ch for some in training.values() for t in some for ch in squeeze(t)}
    out = {}
    for lang, some in training.items():
        grams = [Counter(s[i : i + n] for s in map(squeeze, some) for i in range(len(s) - n + 1)) for n in range(1, 5)]
        counts = [Counter(g[1:] for g in grams[n + 1]) if n < 3 else grams[3] for n in range(4)]
        total, kinds = [Counter() for _ in range(4)], [Counter() for _ in range(4)]
        for n in range(4):
            for g, c in counts[n].items():
                total[n][g[:-1]] += c
                kinds[n][g[:-1]] += 1

        def p(g):
            n = len(g) - 1
            low = p(g[1:]) if n else 1 / (2 + len(alphabet))
            if not total[n][g[:-1]]:
                return low
            return max(0, counts[n][g] - d) / total[n][g[:-1]] + d * kinds[n][g[:-1]] / total[n][g[:-1]] * low

        s = squeeze(text)
        out[lang] = -sum(math.log(p(s[max(0, i - 3) : i + 1])) for i in range(1, len(s))) / max(1, len(s) - 1)
    return out


def test_language_losses_equal_brute_force(spark):
    rows = [(i, " ".join("".join(RANDOM.choices(a, k=3)) for _ in range(12)) + RANDOM.choice([".", " 7", "É!"]), lang) for i in range(30) for lang, a in (("aa", ["ka", "lo", "mi"]), ("bb", ["sch", "ein", "ka"]))]
    rows = [(k, t, lang) for k, (_, t, lang) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df.unionByName(df))
    picked = langid.sample(df.unionByName(df)).collect()
    assert len(picked) == 60 and langid.sample(df, n=7).count() == 14
    training = {lang: [r.text for r in picked if r.lang == lang and r.k % 5] for lang in ("aa", "bb")}
    for text in [rows[0][1], rows[1][1], "Mika LO ein", "x"]:
        losses, _ = model.losses(*text_bytes(__import__("pyarrow").array([text])))
        want = brute_kneser_ney(training, text)
        if set(text.lower()) <= set("".join(t.lower() for t in training["aa"] + training["bb"])):
            assert np.allclose(losses[0], [want["aa"], want["bb"]], atol=1e-3)
            assert losses[0].argmin() == int(want["bb"] < want["aa"])
        else:  # a symbol that no language knows costs the same in each
            assert losses[0, 0] == losses[0, 1]


def test_cross_entropy_difference(docs, texts, spark, empty):
    target = [prose(30) for _ in range(5)] + [None]
    tdf = spark.createDataFrame([(t,) for t in target], "text string")
    counts = Counter(w for t in [*target, *texts] for w in words(t))
    by_count = sorted(counts.values(), reverse=True)
    size = next(k for k in range(20, len(by_count)) if by_count[k - 1] > by_count[k])  # no tie at the border of the classes
    known = {w for w, c in counts.items() if c >= by_count[size - 1]}
    fitted = lmscore.train(tdf, docs, size=size)
    got = {r.doc_id: r for r in lmscore.score(docs, fitted, group_bytes=4096).collect()}
    prose_new = "zq never " + prose(20) + " seen zq"  # words that no model has seen
    new = {r.doc_id: r for r in lmscore.score(spark.createDataFrame([(0, prose_new)], "doc_id long, text string"), fitted).collect()}
    assert len(got) == len(texts)
    rare = {w for w in counts if w not in known}

    def model(some):
        pairs, own = Counter(), Counter()
        for t in some:
            own.update(w for w in words(t) if w in rare)
            ids = [w if w in known else b"?" for w in words(t)]
            pairs.update(zip([b"^", *ids], ids, strict=False))
        one, total, kinds = Counter(), Counter(), Counter()
        for (a, b), c in pairs.items():
            one[b] += c
            total[a] += c
            kinds[a] += 1
        every = sum(one.values()) + size + 1

        def loss(a, b, word):
            weight = kinds[a] / (total[a] + kinds[a]) if total[a] else 1.0
            out = -math.log((1 - weight) * pairs[a, b] / max(1, total[a]) + weight * (one[b] + 1) / every)
            if word not in known:
                out -= math.log((own[word] + len(own) / (len(rare) + 1)) / (sum(own.values()) + len(own)))
            return out

        return loss

    t_loss, b_loss = model(target), model(texts)
    for rows, of in ((got, texts), (new, [prose_new])):
        for i, t in enumerate(of):
            ids = [w if w in known else b"?" for w in words(t)]
            steps = list(zip([b"^", *ids], ids, words(t), strict=False))
            assert rows[i].n_words == len(ids)
            if ids:
                assert abs(rows[i].difference - sum(t_loss(*s) - b_loss(*s) for s in steps) / len(ids)) < 1e-4
            else:
                assert rows[i].difference is None
    assert lmscore.score(empty, lmscore.train(tdf.where("false"), empty)).count() == 0


def test_cross_entropy_counts_pairs_of_all_words(docs, texts, spark):
    target = [prose(30) for _ in range(5)] + [None, texts[6]]
    fitted = lmscore.train(spark.createDataFrame([(t,) for t in target], "text string"), docs)
    new = ["zq never " + prose(20) + " seen zq", texts[6]]
    vocabulary = {w for t in [*target, *texts] for w in words(t)}

    def model(some):
        pairs, one, total, kinds = Counter(), Counter(), Counter(), Counter()
        for t in some:
            one.update(words(t))
            pairs.update(zip([b"^", *words(t)], words(t), strict=False))
        for (a, _), c in pairs.items():
            total[a] += c
            kinds[a] += 1

        def loss(a, b):
            even = (one[b] + 1) / (sum(one.values()) + len(vocabulary) + 1)
            return -math.log((pairs[a, b] + kinds[a] * even) / (total[a] + kinds[a]) if total[a] else even)

        return loss

    t_loss, b_loss = model(target), model(texts)
    for of, df, group_bytes in ((texts, docs, 4096), (texts, docs, 1 << 24), (new, spark.createDataFrame(list(enumerate(new)), "doc_id long, text string"), 4096)):
        got = {r.doc_id: r for r in lmscore.score(df, fitted, group_bytes=group_bytes).collect()}
        assert len(got) == len(of)
        for i, t in enumerate(of):
            steps = list(zip([b"^", *words(t)], words(t), strict=False))
            assert got[i].n_words == len(steps)
            if steps:
                assert abs(got[i].target_loss - sum(t_loss(*s) for s in steps) / len(steps)) < 1e-6
                assert abs(got[i].background_loss - sum(b_loss(*s) for s in steps) / len(steps)) < 1e-6
            else:
                assert got[i].difference is None


def test_pipeline(spark, tmp_path, docs, texts):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        rows = spark.read.parquet(f"{tmp_path}/{name}")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == rows.count()
    # near_dedup on its own input: one of every group stays, with all its columns
    want = {r.doc_id for r in neardup.near_duplicates(docs).where("kept").collect()}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs.unionByName(docs.where("doc_id = 6")), str(tmp_path)).collect()} == want
    cut = {r.doc_id: r.text for r in corpus_pipeline.suffix_dedup(spark, docs, str(tmp_path)).collect()}
    assert cut[3] == "one" and cut[14] == "" and len(cut) == len(texts)


def test_pipeline_near_dedup_decides_per_text(spark, tmp_path):
    a, b, c = prose(60), prose(60), prose(60)
    rows = [(None, a), (None, b), (7, b), (7, c), (7, c), (None, c), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, df, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([(None, a), (7, b), (7, c)], key=str)


def test_pipeline_suffix_dedup_cuts_planted_passages(spark, tmp_path):
    """Passages of 51 to 100 words in otherwise different documents go; other text stays, as a brute-force version says."""
    passages = [prose(RANDOM.randint(51, 100)) for _ in range(12)]
    rows, planted = [], {}
    for i in range(60):
        parts = [prose(RANDOM.randint(20, 200)), prose(RANDOM.randint(20, 200))]
        if i < 36:
            planted[i] = passages[i % 12]
            parts.insert(1, passages[i % 12])
        rows.append((i, "\n".join(parts), "en", "s", 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.suffix_dedup(spark, df, str(tmp_path)).collect()}
    caught = sum(p not in got[i].text and len(got[i].text) < len(rows[i][1]) - 200 for i, p in planted.items()) / len(planted)
    clean = [i for i in range(60) if i not in planted]
    left = sum(got[i].text == rows[i][1] for i in clean) / len(clean)
    print("caught", caught, "clean documents left alone", left)
    assert caught == 1 and left == 1
    for i, want in enumerate(brute_repeats([data(r[1]) for r in rows], corpus_pipeline.PASSAGE)):
        body = rows[i][1].encode()
        assert got[i].n_chars == len(got[i].text) and (want[3] == hashlib.sha256(got[i].text.encode()).hexdigest() or len(body) - want[1] - len(got[i].text.encode()) <= 2)
