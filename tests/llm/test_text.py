"""The text operators against brute force, other implementations and exact round trips."""

import itertools
import pathlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.oracle import duck, spark_rows
from tidemark.functions.columns import item_text
from tidemark.llm import bpe, leakage, quality, queries
from tidemark.llm.bpe import KEPT_LENGTH, MAX_STATES, Encoder, Utf8Tail, decode_stream, pieces, read_ranks
from tidemark.llm.cooccurrence import Support, far_from_chance, frequent_pairs
from tidemark.llm.fmindex import FMIndex, suffix_order
from tidemark.llm.tokenize import VOCABULARY, decoded_digest, token_ids

FOLDER = "/root/testdata/sf0.001"
PLAIN = settings(max_examples=60, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))


def documents():
    return duckdb.connect().execute(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()


# 4

BASKETS = "basket string, items array<string>, n int, item string"


def brute_pairs(data, support):
    by = defaultdict(set)
    for basket, items, *_ in data:
        if basket is not None:
            by[basket] |= {i.strip(" ").lower() for i in items or [] if i and i.strip(" ")}
    sets = [s for s in by.values() if s]
    n, one = len(sets), Counter(i for s in sets for i in s)
    two = Counter(p for s in sets for p in itertools.combinations(sorted(s), 2))
    return {(a, b): (k, one[a], one[b], n) for (a, b), k in two.items() if k >= support.least and k * support.one_in >= n}


@pytest.mark.parametrize("broadcast_items", [1000, 0])
def test_pairs(spark, broadcast_items):
    r = random.Random(3)
    tags = ["A", " a", "b", "B ", "c", "d", "e", "f", "", "  ", None]
    data = [(r.choice(["hot"] * 30 + [f"k{i}" for i in range(60)] + [None]), r.choice([None, [], r.choices(tags, k=r.randrange(6))]), 1, "x") for _ in range(400)]
    data += [(f"big{i}", ["p", "q", "p"], 1, "x") for i in range(9)] + [("every", list("abcdefpq") + [f"rare{i}" for i in range(50)], 1, "x")]
    support = Support(3, 40, broadcast_items)
    df = spark.createDataFrame(data, BASKETS)
    got = frequent_pairs(df, "basket", "items", item_text(F.col("item")), support)
    want = brute_pairs(data, support)
    assert {(x.a, x.b): (x.n_ab, x.n_a, x.n_b, x.n) for x in got.collect()} == want
    for x in got.collect():
        assert x.lift == pytest.approx(x.n_ab * x.n / (x.n_a * x.n_b))
        assert (x.conviction is None) == (x.n_ab == x.n_a)
    assert {(x.a, x.b) for x in far_from_chance(got, 3).collect()} == {p for p, (k, a, b, n) in want.items() if k * n >= 3 * a * b}
    assert frequent_pairs(df.limit(0), "basket", "items").isEmpty()


# 8


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(pathlib.Path(VOCABULARY).read_bytes())


@pytest.fixture(scope="module")
def encoder(ranks):
    return Encoder(ranks)


@pytest.fixture(scope="module")
def other():
    """Another library's encoder over the same vocabulary."""
    tokenizers = pytest.importorskip("tokenizers")
    found = tokenizers.Tokenizer.from_file(str(pathlib.Path(VOCABULARY).with_suffix(".json")))
    found.encode_special_tokens = True
    return lambda text: found.encode(text, add_special_tokens=False).ids


ODD = [
    "", "<|endoftext|> text", "é" * 999, "=" * 20_000, " " * 5000 + "x", "a" * 9000, "\x1c\x1d a  b\x85c  　d", "日本語テキスト" * 200,
    "\n\n  \n x\t\ty  ", "I'm you'll we'Ve 'tis", "½ ² Ⅳ ١٢٣", "áë e️ 👩‍👩‍👧", "\r\n\r\n \r", "naïve  café   x", "\x00\x1b[0;31mred\x1b[0m", "'s's 's", "12345678901234567890" * 50,
]


def encode(encoder, texts):
    ids, offsets = encoder.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


def test_ids_equal_another_librarys(encoder, other):
    texts = [t or "" for _, t in documents()] + ODD
    assert encode(encoder, texts) == [other(t) for t in texts]


@PLAIN
@given(text=st.text(st.characters(exclude_categories=["Cs"]), max_size=60) | st.text(" \t\nab'sé1½-=", max_size=60))
def test_any_text(encoder, other, text):
    (got,) = encode(encoder, [text])
    assert got == other(text)
    assert "".join(pieces(text)) == text
    assert "".join(decode_stream(got, encoder.transducer.bytes_of, 3)) == text


def test_a_full_transducer_gives_the_same(ranks, other):
    small = Encoder(ranks, max_pieces=50, max_states=30)
    texts = [t or "" for _, t in documents()[:40]] + ODD
    for text in texts:
        assert encode(small, [text]) == [other(text)]
    assert small.transducer.evictions > 20


def test_every_piece_goes_through_the_transducer(ranks):
    """None is encoded in any other way, over all documents of the largest folder; its states stay few."""
    folder = "/root/testdata/sf0.1"
    texts = [t for (t,) in duckdb.connect().execute(f"SELECT text FROM '{folder}/documents.parquet'").fetchall()]
    whole = Encoder(ranks, max_pieces=10**9)
    for i in range(0, len(texts), 500):
        whole.encode(texts[i : i + 500])
    met = {p for t in texts if t for p in pieces(t)}
    assert set(whole.pieces) == {p for p in met if len(p) <= KEPT_LENGTH}
    assert whole.transducer.pieces_read >= len(met) == len(whole.pieces) + sum(len(p) > KEPT_LENGTH for p in met)
    assert whole.transducer.evictions == 0 and len(whole.transducer.states) < MAX_STATES


@pytest.mark.parametrize("window", [1, 3])
def test_long_pieces_in_windows(ranks, other, monkeypatch, window):
    monkeypatch.setattr(bpe, "WINDOW", window)
    monkeypatch.setattr(bpe, "LONG_PIECE", 2)
    small = Encoder(ranks, max_states=20)
    for text in [*ODD, "ab" * 40, "internationalisation", "Donaudampfschifffahrtsgesellschaft"]:
        assert encode(small, [text]) == [other(text)]


@PLAIN
@given(texts=st.lists(st.none() | st.text("ab \t\n\r\x0b\x1c\x85\xa0\u2003\u3000é\u4e05", max_size=12), max_size=6))
def test_units_are_cut_where_pieces_end(encoder, other, texts):
    assert encode(encoder, texts) == [other(t or "") for t in texts]
    assert encode(encoder, pa.array([None, "x y", *texts], pa.string())[2:]) == [other(t or "") for t in texts]


def test_neighbours_agree_as_defined(encoder):
    r, t = random.Random(1), encoder.transducer.merges
    for _ in range(5000):
        a, b = r.randrange(len(t.bytes_of)), r.randrange(len(t.bytes_of))
        assert t.agree(a, b) == (t.merged(t.bytes_of[a] + t.bytes_of[b]) == [a, b])


@PLAIN
@given(raw=st.binary(max_size=30) | st.text(max_size=12).map(lambda s: s.encode("utf-8", "surrogatepass")), cuts=st.lists(st.integers(0, 30)))
def test_decoding_does_not_depend_on_the_cuts(raw, cuts):
    machine, at, out = Utf8Tail(), 0, ""
    for cut in sorted(cuts):
        out += machine.feed(raw[at:cut])
        at = max(at, cut)
    out += machine.feed(raw[at:]) + machine.finish()
    assert out == raw.decode("utf-8", "replace")


def test_corpus_of_odd_rows(spark, other):
    rows = [(i, t, "x") for i, t in enumerate([*ODD, None, "same", "same"])]
    encoded = token_ids(spark.createDataFrame(rows, "doc_id bigint, text string, ids string"))
    assert {r.doc_id: r.ids for r in encoded.collect()} == {i: other(t or "") for i, t, _ in rows}
    assert [str(f.dataType) for f in encoded.schema] == ["LongType()", "ArrayType(IntegerType(), True)"]
    assert {r.doc_id: r.n_bytes for r in decoded_digest(encoded).collect()} == {i: len((t or "").encode()) for i, t, _ in rows}
    assert token_ids(spark.createDataFrame([], "doc_id string, text string")).isEmpty()


# 9


@PLAIN
@given(symbols=st.lists(st.integers(0, 3), max_size=60), size=st.integers(1, 4))
def test_index(symbols, size):
    symbols = np.array([*symbols, 0], np.int32)
    n, separators = len(symbols), np.flatnonzero(symbols == 0)
    values = symbols.astype(int) + len(separators)
    values[separators] = range(len(separators))
    assert suffix_order(symbols).tolist() == sorted(range(n), key=lambda i: values[i:].tolist())
    index = FMIndex(symbols, 4)
    patterns = np.array(list(itertools.product((1, 2, 3), repeat=size)), np.int64)
    for pattern, low, high in zip(patterns, *index.ranges(patterns)):
        want = [i for i in range(n - size + 1) if symbols[i : i + size].tolist() == pattern.tolist()]
        assert sorted(index.locate(np.arange(low, high)).tolist()) == want


def test_index_of_many_copies():
    one = np.array([1, 2, 1, 3, 1, 2, 2, 1, 0], np.int32)
    index = FMIndex(np.tile(one, 3000), 4)
    ((low,), (high,)) = index.ranges(np.array([[1, 2, 1, 3]]))
    assert high - low == 3000
    assert sorted(index.locate(np.arange(low, high)).tolist()) == list(range(0, 27000, 9))


def test_words():
    assert leakage.words("Café CAFÉ, na-ïve_x2") == ["cafe", "cafe", "na", "ive", "x2"]
    assert leakage.words("ABC def-12") == ["abc", "def", "12"]


def brute_leaks(docs, items, size):
    runs = defaultdict(set)
    for item, passage in items:
        w = leakage.words(passage or "")
        for i in range(len(w) - size + 1):
            runs[tuple(w[i : i + size])].add(item)
    found, spans = set(), set()
    for key, text in docs:
        w, covered = leakage.words(text or ""), set()
        for i in range(len(w) - size + 1):
            if hit := runs.get(tuple(w[i : i + size])):
                found |= {(key, item) for item in hit}
                covered |= {(i, i + size)}
        merged = []
        for a, b in sorted(covered):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = b
            else:
                merged.append([a, b])
        spans |= {(key, n + 1, a, b) for n, (a, b) in enumerate(merged)}
    return found, spans


@pytest.mark.parametrize("shard_words", [9, 40, 100_000])
def test_leaks(spark, shard_words):
    r = random.Random(4)
    text = lambda n: " ".join(r.choices(["a", "B", "ç", "d-1"], k=n))
    items = [(i, text(r.randrange(3, 14))) for i in range(12)]
    items += [(50, items[0][1]), (51, None), (None, "a b c d e"), (52, "")]
    docs = [(i, r.choice(["", "\n", "x y. "]) + text(r.randrange(60)) + " zz " + items[r.randrange(12)][1].upper()) for i in range(60)]
    docs += [(900, None), (901, ""), (None, items[0][1]), (902, "short"), *docs[:5], *[(910 + i, items[3][1]) for i in range(30)], (999, text(700))]
    found, spans = brute_leaks([d for d in docs if d[0] is not None], [i for i in items if i[0] is not None], 5)
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, item_id int")
    e = spark.createDataFrame([(*x, "x") for x in items], "item_id bigint, passage string, doc_id string")
    assert {tuple(x) for x in leakage.leaked_items(d, e, size=5, shard_words=shard_words).collect()} == found
    assert {tuple(x) for x in leakage.leaked_spans(d, e, size=5, shard_words=shard_words).collect()} == spans
    assert leakage.leaked_items(d, e.limit(0), size=5).isEmpty() and leakage.leaked_items(d.limit(0), e, size=5).isEmpty()


def test_blocks_of_items(spark, monkeypatch):
    """Items in several blocks go through one index, which is read once."""
    monkeypatch.setattr(leakage, "BLOCK_BYTES", 10)
    d = spark.createDataFrame([(1, "a b c d e f"), (2, "c d e")], "doc_id bigint, text string")
    e = spark.createDataFrame([(i, p) for i, p in enumerate(["a b c", "c d e", "x y z", "d e f", "b c d"])], "item_id bigint, passage string")
    assert len(list(leakage._item_blocks(e, "item_id", "passage"))) == 3
    found = leakage.leaked_items(d, e, size=3)
    assert {tuple(x) for x in found.collect()} == {(1, 0), (1, 1), (1, 3), (1, 4), (2, 1)}
    plan = found._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert plan.count("FileScan") == plan.count("MapInArrow") == 1


def test_an_index_is_kept(spark, tmp_path):
    """Written once, it is opened later and searched for items that were not there then."""
    docs = [(i, t) for i, t in documents() if t]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    leakage.index_corpus(d, size=4, shard_words=3000, path=f"{tmp_path}/index")
    later = [(n, " ".join(leakage.words(docs[n][1])[n : n + 9]).upper()) for n in range(0, 60, 7)]
    index = spark.read.parquet(f"{tmp_path}/index")
    found = {tuple(x) for x in leakage.search_items(index, spark.createDataFrame(later, "item_id bigint, passage string"), size=5).collect()}
    assert found == brute_leaks(docs, later, 5)[0] and found


@PLAIN
@given(symbols=st.lists(st.integers(0, 5), min_size=1, max_size=80))
def test_an_index_as_bytes(symbols):
    index = FMIndex(np.array([*symbols, 0], np.int32), 6)
    again = FMIndex.from_bytes(index.to_bytes())
    patterns = np.array(list(itertools.product(range(1, 6), repeat=2)), np.int64)
    for a, b in zip(index.ranges(patterns), again.ranges(patterns)):
        assert (a == b).all()
    rows = np.arange(index.size)
    assert (index.locate(rows) == again.locate(rows)).all()


def test_leaks_of_the_data(spark):
    items = duckdb.connect().execute(f"SELECT item_id, passage FROM '{FOLDER}/eval_items.parquet'").fetchall()
    found, spans = brute_leaks(documents(), items, leakage.WORDS)
    assert {tuple(x) for x in queries.p9_found(spark, FOLDER).collect()} == found and found
    assert {tuple(x) for x in queries.p9_spans(spark, FOLDER).collect()} == spans


# 10


def brute_counts(text, common):
    text = text or ""
    found = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    lines = [x for x in (line.rstrip(" \t\r") for line in text.split("\n")) if x]
    return (
        len(found), sum(map(len, found)), sum(c in quality.PUNCTUATION for c in text),
        sum(w.strip(quality.PUNCTUATION).lower() in common for w in found), len(lines), sum(x[-1] in ".!?" for x in lines),
    )


@PLAIN
@given(text=st.none() | st.text(max_size=60) | st.text("The., \t\r\n!?é\x0b\x85(", max_size=80))
def test_counts(text):
    common = frozenset({"the", "", "é"})
    assert quality.counts(text, quality._Common(common)) == brute_counts(text, common)


def test_common_words_in_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "the cat, The dog and THE mat"), (2, None), (3, "a")], "doc_id bigint, text string")
    common = spark.createDataFrame([(w,) for w in ["the", "dog", "mat", "and", "a", None, "the"]], "word string")
    whole = spark_rows(quality.text_counts(docs, common))
    for size in (1, 2, 5, 6):
        monkeypatch.setattr(quality, "COMMON_WORDS_AT_ONCE", size)
        assert spark_rows(quality.text_counts(docs, common)) == whole
    assert {r.doc_id: r.n_common for r in quality.text_counts(docs, common).collect()} == {1: 6, 2: 0, 3: 1}


def test_learning_finds_planted_accuracies():
    rng = np.random.default_rng(7)
    truth = rng.random(40_000) < 0.3
    right = np.array([[0.9, 0.8], [0.75, 0.9], [0.6, 0.7], [0.95, 0.65], [0.8, 0.8]])  # of prose, of not prose
    votes = np.where(rng.random((40_000, 5)) < np.where(truth[:, None], right[:, 1], right[:, 0]), truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.2] = quality.ABSTAIN
    patterns, weights = np.unique(votes, axis=0, return_counts=True)
    model = quality.learn(patterns, weights.astype(float))
    for cls, column in ((quality.PROSE, 0), (quality.NOT_PROSE, 1)):
        spoke = model.table[cls, :, cls] / model.table[cls, :, :2].sum(axis=1)
        assert np.abs(spoke - right[:, column]).max() < 0.03
    assert abs(model.prior[quality.NOT_PROSE] - 0.3) < 0.02
    held_out = model.posterior(votes) >= 0.5
    assert (held_out == truth).mean() > 0.9


def test_learning_from_nothing():
    assert quality.learn(np.empty((0, 3), int), np.empty(0)).prior.tolist() == [0.5, 0.5]


PROSE_TEXT = "The cat sat on the mat and it was all that we had to do in the house.\n" * 5
TABLE_TEXT = "| 1.0 | 2.0 |\n" * 30


def test_types(spark):
    rows = [(1, PROSE_TEXT, "x"), (2, TABLE_TEXT, "x"), (3, None, "x"), (4, " \n", "x"), (5, PROSE_TEXT, "x"), (None, TABLE_TEXT, "x"), (7, "A" * 100_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_words string")
    common = spark.createDataFrame([(w, "en") for w in ["the", "it", "was", "all", "and", "to", "in", "on", "we", "that", None]], "word string, lang string")
    got = {r.doc_id: r for r in quality.text_types(docs, common).collect()}
    assert [got[k].text_type for k in (1, 2, 3, 4, None, 7)] == ["prose", "not_prose", "empty", "empty", "not_prose", "not_prose"]
    assert got[3].p_not_prose is None and got[1].p_not_prose == got[5].p_not_prose < 0.5
    ruled = quality.text_types(docs, common).where(quality.stated_rule())
    assert {r.doc_id for r in ruled.collect()} == {2, 7, None}
    assert quality.text_types(docs.limit(0), common).isEmpty()
    assert quality.text_counts(docs, common.limit(0)).agg(F.sum("n_common")).first()[0] == 0


# the queries


def test_found_comes_through_what_is_learnt(spark, monkeypatch):
    """A model with its classes exchanged, or one that knows nothing, gives other rows."""
    found = set(spark_rows(queries.QUERIES["p10_found"](spark, FOLDER))[1])
    learn = quality.learn

    def turned(*args, **more):
        model = learn(*args, **more)
        return quality.VoteModel(model.prior[::-1], model.table[::-1])

    for wrong in (turned, lambda patterns, weights, anchored: quality.VoteModel(np.array([0.9, 0.1]), np.full((2, patterns.shape[1], 3), 1 / 3))):
        monkeypatch.setattr(quality, "learn", wrong)
        assert set(spark_rows(queries.QUERIES["p10_found"](spark, FOLDER))[1]) < found


def test_one_anchored_vote_outweighs_all_else():
    functions = quality.votes()
    assert quality.FLOOR ** (len(functions) + 1) / quality.ANCHOR > 1
    anchored = [i for i, v in enumerate(functions) if v.anchored]
    patterns = np.array(list(itertools.product(range(3), repeat=len(functions))))
    against = (patterns[:, anchored] == quality.NOT_PROSE).any(axis=1)
    rng = np.random.default_rng(3)
    for _ in range(40):  # corpora of any kind, most of them far from what the functions are made for
        weights = rng.random(len(patterns)) ** rng.integers(1, 60) * rng.choice([1, 1e9])
        assert (quality.learn(patterns, weights, anchored=anchored).posterior(patterns)[against] > 0.5).all()


def plain_posterior(rows):
    """The same model written out for single documents: (votes, P(not prose)) of counts with at least one word."""
    w, c, s, k, n, e = rows.T
    cast = lambda against, other: np.where(against, 1, np.where(other, 0, 2))
    clauses = [c >= 10 * w, 4 * s >= c, (100 * k < 15 * w) & (5 * e < n)]
    votes = [*[cast(x, ~x) for x in clauses], cast(w < 4 * n, w >= 10 * n)]
    held = lambda p: [0.01 + 0.97 * x / sum(p) for x in p]
    good, bad = [held([0.7, 0.3, 0.5]) for _ in votes], [held([0.3, 0.7, 0.5]) for _ in votes]
    prior = 0.5
    for i in range(101):
        if i:
            prior = 0.01 + 0.98 * (p.sum() + 1e-9) / (len(p) + 2e-9)
            good = [held([((1 - p) * (v == x)).sum() + 1e-9 for x in range(3)]) for v in votes]
            bad = [held([(p * (v == x)).sum() + 1e-9 for x in range(3)]) for v in votes]
        for clause in range(3):
            good[clause][1] = 1e-12
        one, other = np.full(len(rows), prior), np.full(len(rows), 1 - prior)
        for v, g, b in zip(votes, good, bad):
            one, other = one * np.array(b)[v], other * np.array(g)[v]
        p = one / (one + other)
    return p, np.logical_or.reduce(clauses)


@pytest.mark.parametrize("scale", ["0.001", "0.01", "0.1"])
def test_types_of_the_data(spark, scale):
    """Against the model written out, and against the stated rule: every document of the rule is a candidate, and few others are."""
    got = queries.p10_types(spark, f"/root/testdata/sf{scale}").where("n_words > 0").toPandas()
    p, ruled = plain_posterior(got[list(quality.COUNTS)].to_numpy(float))
    assert np.abs(got.p_not_prose.to_numpy() - p).max() < 2e-6
    typed = (got.text_type == "not_prose").to_numpy()
    assert (typed == (p >= 0.5)).all() and typed[ruled].all()
    assert ruled.sum() / typed.sum() >= 0.9


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, name):
    got = spark_rows(queries.QUERIES[name](spark, FOLDER))
    if name in queries.SQL:
        assert got == duck(FOLDER, queries.SQL[name])


@pytest.mark.parametrize("name", queries.QUERIES)
def test_empty_tables(spark, tmp_path, name):
    for path in pathlib.Path(FOLDER).glob("*.parquet"):
        duckdb.connect().execute(f"COPY (SELECT * FROM '{path}' LIMIT 0) TO '{tmp_path}/{path.name}' (FORMAT parquet)")
    got = queries.QUERIES[name](spark, str(tmp_path))
    assert got.count() == 0 and got.columns == queries.QUERIES[name](spark, FOLDER).columns
