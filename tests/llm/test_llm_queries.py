"""The registered queries: against SQL, against brute force, and on edge cases."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from compare import same_rows

from panelwright.llm import queries

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf, duck, name):
    same_rows(queries.queries()[name](spark, sf).toPandas(), duck.execute(queries.oracle_sql()[name]).df())


@pytest.fixture(scope="module")
def texts(some):
    return {r.doc_id: r.text for r in some.collect()}


def test_rules_by_hand(docs_of):
    from panelwright.llm.rules import quality_rules

    rows = [(1, "a b c a b c"), (2, "a a a a"), (3, "x y z x y q"), (4, "#a\n\n#a\n \n#a"), (5, None), (6, "a b"), (7, "a b c d a b c")]
    got = {r.doc_id: r for r in quality_rules(docs_of(rows)).collect()}
    assert [got[i].n_repeat_words for i in range(1, 8)] == [6, 4, 0, 0, 0, 0, 6]
    assert got[4].n_dup_lines == 2 and got[4].n_symbols == 3 and got[4].word_chars == 6 and got[5].n_words == 0
    assert all(r.base_failed and not r.kept for r in got.values())


def test_rules_keep_prose(some):
    from panelwright.llm.rules import quality_rules

    labels = some.sparkSession.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = some.sparkSession.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality_rules(docs).where("NOT base_failed").join(labels, "doc_id").toPandas()
    assert rows[rows.quality == 1].kept.mean() > 0.98 and rows[rows.quality == 0].kept.mean() < 0.3


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op2_quality_classifier(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.9 and (held[held.quality == 1].predicted == 1).mean() > 0.95
    again = queries.op2_quality_classifier(spark, sf).toPandas().set_index("doc_id").score
    assert np.allclose(got.set_index("doc_id").score.sort_index(), again.sort_index(), atol=1e-6)


def test_word_vectors_by_hand(docs_of):
    """Context vectors and pooled features, word by word in plain numpy."""
    from panelwright.llm import classifier as c

    rng = np.random.default_rng(5)
    vocabulary = ["The", "the", "river", "RUNS", "down", "42", "a-b", "x" * 300, "ß", "hill"]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 30)))) for i in range(60)] + [(99, None)]
    head, vectors = c.word_vectors(docs_of(rows), head=6)
    count = Counter(w.encode().lower() for _, t in rows for w in words(t))
    assert 0 < len(head.index) <= 6 and set(head.index) == {w for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[: len(head.index)]}
    draws, shapes = c.index_vectors(c.DRAWS).astype(float), c.index_vectors(c.SHAPES, seed=29).astype(float)
    row = lambda w: head.index.get(w.lower(), len(head.index) + zlib.crc32(w.lower()) % c.BUCKETS)
    own = lambda w: draws[(zlib.crc32(w.lower()) >> 10) % c.DRAWS]
    shape = lambda w: shapes[zlib.crc32(re.sub(rb"[0-9]+", b"0", re.sub(rb"[A-Z]+", b"A", re.sub(rb"[a-z\x80-\xff]+", b"a", w)))) % c.SHAPES]
    want = np.zeros(vectors.shape)
    for _, t in rows:
        w = [x.encode() for x in words(t)]
        for i in range(len(w)):
            for j in range(max(0, i - 2), min(len(w), i + 3)):
                if i != j:
                    want[row(w[i])] += own(w[j])
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    assert np.allclose(vectors, want, atol=1e-5)
    got = c.pooled([(t or "").encode() for _, t in rows], head, vectors)
    for (_, t), x in zip(rows, got):
        w = [y.encode() for y in words(t)]
        mean = [sum((f(y) for y in w), np.zeros(c.DIM)) / max(1, len(w)) for f in (lambda y: want[row(y)] + own(y) / 8**0.5, lambda y: shape(y) / 8**0.5)]
        assert np.allclose(x, [*mean[0], *mean[1], *map(np.linalg.norm, mean), np.log1p(len(w)) / 10], atol=1e-4)


def test_simhash_against_all_pairs(spark, some, texts):
    got = queries.op8_simhash_near_dedup(spark, "/root/testdata/sf0.001").toPandas().set_index("doc_id")
    prints = {}
    for i, t in texts.items():
        w = words(lower(t))
        grams = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert got.fingerprint[i] == f"{prints[i]:016x}"
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert got.component_id.to_dict() == {i: find(i) for i in ids}


def test_packing_holds_every_id_once(spark, texts):
    from tokenizers import Tokenizer

    from panelwright.llm.tokens import vocabulary

    got = queries.op4_packing(spark, "/root/testdata/sf0.001").toPandas().sort_values(["doc_id", "start"])
    t = Tokenizer.from_file(vocabulary())
    want = {i: [*t.encode(x, add_special_tokens=False).ids, 2] for i, x in texts.items()}
    for i, pieces in got.groupby("doc_id"):
        assert (pieces.doc_tokens == len(want[i])).all()
        assert list(pieces.start) == [0, *pieces.length.cumsum()[:-1]] and pieces.length.sum() == len(want[i])
        for p in pieces.itertuples():
            assert zlib.crc32(np.array(want[i][p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
    assert set(got.doc_id) == set(want)
    padding = 0
    for _, s in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert list(s.offset) == [0, *s.length.cumsum()[:-1]]
        n = s.length.sum()
        assert n <= 4096
        padding += 0 if n & (n - 1) == 0 else 4096 - n
    assert padding == 0


def test_lm(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op5_lm_scoring(spark, sf).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    tokens = {i: [*words(lower(t)), "\n"] for i, t in zip(docs.doc_id, docs.text)}
    count = Counter(w for i, x in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in x)
    n, v = sum(count.values()), len(count)
    for i, x in tokens.items():
        r = got.loc[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(x), sum(w in count for w in x), n)
        assert abs(r.base_score - sum(np.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x)) < 1e-6
    held = got[got.held_out]
    # scores are negative; a tenth of the base's 4.1 digits a token is less than what telling the languages apart gains
    assert held.score.sum() > held.base_score.sum() * 0.95 and (got.score < 0).all()
    assert (held.score > held.base_score).mean() > 0.9


def test_lm_probabilities_add_up(spark):
    """Over all known words and one unknown word of each ending, for a trained model and some context."""
    from panelwright.llm import lm

    rng = np.random.default_rng(0)
    words_ = sorted({"".join(rng.choice(list("abcdef"), rng.integers(1, 5))) for _ in range(300)})
    counts = spark.createDataFrame([(w.encode(), int(n)) for w, n in zip(words_, rng.integers(1, 50, len(words_)))], "word binary, n long")
    h = lm.learn_head(counts, 100, 64)
    assert 0 < len(h.counts) <= 100 and h.classes == 64 and h.distinct == len(words_)
    by_class = Counter()
    for w, n in counts.collect():
        by_class[h.codes()[bytes(w)] % h.classes] += n + 0.1
    for c in range(h.plain, h.classes):
        by_class[c] += 0.1
    assert np.allclose([by_class[c] for c in range(h.classes)], h.mass)
    m = lm.initial(h, 8, 0)
    lm.train(m, [(rng.integers(0, 64, 5000), rng.integers(0, 64, 5000), rng.integers(0, 64, 5000))], h.unigram())
    lm._PARTITION.clear()
    p = np.exp(m.query(np.full(64, 3), np.full(64, 5)) @ m.out.T + m.bias - lm._partitions(m, b"k", np.full(64, 3), np.full(64, 5))[:, None])[0]
    known = sum(p[h.codes()[bytes(w)] % 64] * (n + 0.1) / h.mass[h.codes()[bytes(w)] % 64] for w, n in counts.collect())
    assert abs(known + sum(p[c] * 0.1 / h.mass[c] for c in range(h.plain, 64)) - 1) < 1e-5


def test_lm_learns_from_context(docs_of):
    """Words that follow each other always: far better than any model without context."""
    from panelwright.llm import lm

    rng = np.random.default_rng(3)
    pairs = [("red", "house"), ("blue", "river"), ("green", "mountain"), ("white", "garden")]
    rows = [(i, " ".join(w for k in rng.integers(0, 4, 40) for w in pairs[k])) for i in range(400)]
    held = lm.score(docs_of(rows), classes=32, dim=8, passes=10).where("held_out").toPandas()
    assert held.score.sum() / held.n_tokens.sum() > -0.36 and held.base_score.sum() / held.n_tokens.sum() < -0.85


def test_media(spark, texts):
    from panelwright.llm import gif

    got = queries.op6_media_columns(spark, "/root/testdata/sf0.001").toPandas().set_index("doc_id")
    for i, t in texts.items():
        data = t.encode()
        padded = data + b" " * (-len(data) % 192 if data else 192)
        r = got.loc[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        media = bytes(r.media)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        # colours by hand: what is composed from the stored bytes is the payload under the palette
        colours = Counter(tuple(c >> 6 for c in gif.PALETTE[b].tolist()) for b in padded)
        by_frame = np.sum([f["histogram"] for f in r.frames], axis=0)
        assert {(k >> 4, k >> 2 & 3, k & 3): n for k, n in enumerate(by_frame.tolist()) if n} == colours
        assert r.feature == bytes(n * 255 // len(padded) for n in by_frame.tolist()).hex()
        assert [f["delay_ms"] for f in r.frames] == [100] * -(-len(padded) // (192 * gif.ROWS))
    assert (got.groupby("payload_sha256").feature.nunique() == 1).all()


def test_token_counts(spark, texts):
    from tokenizers import Tokenizer

    from panelwright.llm import lengths
    from panelwright.llm.tokens import vocabulary

    t = Tokenizer.from_file(vocabulary())
    n = np.array([len(t.encode(x, add_special_tokens=False).ids) for x in texts.values()])
    got = queries.op7_token_counts(spark, "/root/testdata/sf0.001").toPandas()
    assert sorted(got.limit_tokens) == sorted(set(n.tolist()))
    for r in got.itertuples():
        assert (r.n_docs, r.docs_within, r.docs_beyond) == ((n == r.limit_tokens).sum(), (n <= r.limit_tokens).sum(), (n > r.limit_tokens).sum())
        assert (r.tokens_within, r.truncated_tokens, r.total_tokens) == (n[n <= r.limit_tokens].sum(), np.minimum(n, r.limit_tokens).sum(), n.sum())
    h = spark.createDataFrame(pd.DataFrame(Counter(n.tolist()).items(), columns=["tokens", "n_docs"]))
    for c in (0, 7, 300, 10**6):
        assert lengths.truncated_total(h, c).first()[0] == np.minimum(n, c).sum()
    for q in (0.01, 0.5, 0.9, 1.0):
        assert lengths.quantile(lengths.length_answers(h, 64), q).first()[0] == np.sort(n)[int(np.ceil(round(q * len(n), 9))) - 1]


def test_repeats_by_brute_force(some, texts):
    """Every removed stretch of words stands elsewhere, first or earlier; what is left repeats little."""
    from panelwright.llm import substring

    got = {r.doc_id: r for r in substring.remove_repeats(some.select("doc_id", "text")).collect()}
    size, places = 8, {}
    plain = {i: [w.lower() for w in t.split()] for i, t in texts.items()}
    for i in sorted(plain):
        for k in range(len(plain[i]) - size + 1):
            places.setdefault(tuple(plain[i][k : k + size]), []).append((i, k))
    gone = unseen = 0
    for i, t in texts.items():
        r, before = got[i], 0
        assert r.removed_words == sum(s.n_words for s in r.removed) and len(r.text.split()) == len(plain[i]) - r.removed_words
        for s in r.removed:
            part = t[s.start : s.start + s.length]
            assert s.start >= before and part == part.strip() and len(part.split()) == s.n_words >= 20
            before = s.start + s.length
            at = len(t[: s.start].split())
            for k in range(at, at + s.n_words):
                around = [places[tuple(plain[i][j : j + size])] for j in range(max(at, k - size + 1), min(k, at + s.n_words - size) + 1)]
                gone += 1
                unseen += not any(x[0] < (i, j) for j, x in enumerate([sorted(p) for p in around], max(at, k - size + 1)))
    assert gone > 5000 and unseen < 0.02 * gone
    # runs of 50 words or more (half of them different words) that an earlier document holds: few words of them stay
    held = left = 0
    for i, words_ in plain.items():
        repeated = np.zeros(len(words_), bool)
        for k in range(len(words_) - size + 1):
            repeated[k : k + size] |= places[tuple(words_[k : k + size])][0] < (i, k)
        stays = np.ones(len(words_), bool)
        for s in got[i].removed:
            at = len(texts[i][: s.start].split())
            stays[at : at + s.n_words] = False
        edges = np.flatnonzero(np.diff(np.concatenate(([0], repeated.astype(int), [0]))))
        for x, y in zip(edges[::2], edges[1::2]):
            if y - x >= 50 and 2 * len(set(words_[x:y])) >= y - x:
                held, left = held + y - x, left + stays[x:y].sum()
    assert held > 5000 and left < 0.1 * held


def test_rows_without_an_id_of_their_own(docs_of):
    """Rows that share an id, or have none, lose only what stands elsewhere."""
    from panelwright.llm import substring

    rng = np.random.default_rng(2)
    say = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(45)).capitalize() + "."
    for i in (None, 5):
        passage = say()
        rows = [(i, f"{passage} {say()} {say()}"), (i, f"{say()} {say()} {passage}"), (i, f"{say()} {say()} {say()}"), (9, f"{say()} {passage}")]
        got = {r.text_was: r for r in substring.remove_repeats(docs_of(rows).selectExpr("doc_id", "text", "text AS text_was", "'x' AS `row`", "'y' AS digest")).collect()}
        assert len(got) == 4 and got[rows[2][1]].removed_words == 0
        assert sorted(got[t].removed_words > 30 for _, t in rows) == [False, False, True, True]
        for _, t in rows:
            r = got[t]
            for s in r.removed:
                assert t[s.start : s.start + s.length] in passage
        # equal rows are one document
        again = substring.remove_repeats(docs_of([rows[0]] * 3)).collect()
        assert [r.removed_words for r in again] == [0, 0, 0]


def test_planted_passages(docs_of):
    from panelwright.llm import substring

    rng = np.random.default_rng(4)
    say = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    passage = ". ".join(say(9).capitalize() for _ in range(7)) + "."
    rows = [(i, f"{say(40)}. {say(12)} {passage} {say(30)}.\n{say(25)}.") for i in range(6)]
    clean = [(10 + i, f"{say(60)}. Yes. {say(40)}.\n{say(12)}.") for i in range(6)]
    got = {r.doc_id: r for r in substring.remove_repeats(docs_of(rows + clean)).collect()}
    assert passage in got[0].text and not any(passage[:60] in got[i].text or passage[-60:] in got[i].text for i in range(1, 6))
    assert all(got[i].text == t for i, t in clean) and all(len(words(got[i].text)) >= 100 for i in range(6))


def test_passages_without_marks(docs_of):
    """Long sentences without marks or capitals, and title case, amid running words."""
    from panelwright.llm import substring

    rng = np.random.default_rng(8)
    say = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    long, title = [say(60) for _ in range(20)], [say(60).title() for _ in range(10)]
    rows = [(100 * k + i, f"{say(30 + k)} {p} {say(30)}") for k in range(3) for i, p in enumerate(long + title)]
    got = {r.doc_id: r for r in substring.remove_repeats(docs_of(rows)).collect()}
    assert all(got[i].removed_words == 0 for i, _ in rows if i < 100)
    gone = [got[i].removed_words for i, _ in rows if i >= 100]
    assert min(gone) >= 20 and np.mean(gone) >= 42 and max(gone) <= 60


def test_mix_properties(spark, some):
    got = queries.op10_mixing(spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas().set_index("doc_id")
    got["source"] = docs.source[got.doc_id].to_numpy()
    by = got.groupby("source").agg(taken=("taken", "sum"), size=("size", "sum"), target=("target", "first"))
    assert (by.taken == by.target.round()).all() and (got.taken <= 2 * got["size"]).all()
    assert abs(by.target.sum() - 1.5 * by["size"].sum()) < 1 and (by.target <= 2 * by["size"] + 1e-3).all()
    open_ = by[by.target < 2 * by["size"] - 1]
    weight = pd.Series([(5, 2, 1)[k % 3] for k in range(len(by))], index=sorted(by.index))
    assert (open_.target / weight[open_.index]).std() < 1e-3
