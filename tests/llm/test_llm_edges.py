"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for each operator."""

import io
import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelwright.llm import chat, classifier, gif, lengths, lm, mixing, packing, rules, simhash, substring
from panelwright.llm.common import table

LABELS = "doc_id long, quality int, toxic int"


def labels_of(spark, rows=((4, 1, 0), (6, 0, 0), (6, None, None), (None, 1, 0), (8, 0, 0), (9, 1, 1))):
    return spark.createDataFrame(list(rows), LABELS)


OPERATORS = {
    "rules": lambda d: rules.quality_rules(d),
    "classifier": lambda d: classifier.score(d, labels_of(d.sparkSession), ["doc_id"]),
    "packing": lambda d: packing.pack(d).where("start = 0"),
    "lm": lambda d: lm.score(d),
    "media": lambda d: gif.films(d),
    "simhash": lambda d: simhash.near_duplicates(d),
    "substring": lambda d: substring.remove_repeats(d),
    "mixing": lambda d: mixing.mix(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
@pytest.mark.parametrize("kind", ["edge", "clash", "empty"])
def test_rows_in_rows_out(name, kind, edge, clash):
    docs = {"edge": edge, "clash": clash, "empty": edge.limit(0)}[kind]
    rows = OPERATORS[name](docs).collect()
    assert len(rows) == (0 if kind == "empty" else 11)


def test_values_on_edges(edge):
    kept = {r.doc_id: r for r in rules.quality_rules(edge).collect()}
    assert [kept[i].n_words for i in (1, 2, 3, 6, 8)] == [0, 0, 0, 1, 30000] and kept[8].n_repeat_words == 30000
    prints = {r.doc_id: r for r in simhash.near_duplicates(edge).collect()}
    assert {prints[i].fingerprint for i in (1, 2, 3)} == {"0" * 16} and {prints[i].component_id for i in (1, 2, 3)} == {1} and prints[5].component_id == 4
    lengths_ = {r.doc_id: r.doc_tokens for r in packing.pack(edge).where("start = 0").collect()}
    assert lengths_[1] == lengths_[2] == lengths_[3] == 1 and lengths_[8] == 30001
    films = {r.doc_id: r for r in gif.films(edge).collect()}
    assert films[1].payload_bytes == 192 and films[1].media_sha256 == films[2].media_sha256 and films[6].n_bytes == 1
    scores = {r.doc_id: r for r in lm.score(edge).collect()}
    assert scores[1].n_tokens == scores[2].n_tokens == 1 and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in scores.values())
    assert scores[6].n_tokens == 2
    mixed = {r.doc_id: r for r in mixing.mix(edge).collect()}
    assert mixed[1].size == 0 == mixed[1].taken and mixed[8].size == 30000
    h = {r.tokens: r.n_docs for r in lengths.length_histogram(edge).collect()}
    assert h[0] == 3 and sum(h.values()) == 11 and lengths.length_answers(lengths.length_histogram(edge.limit(0))).isEmpty()


def test_untrainable_tables(spark, edge, docs_of):
    s = classifier.score(edge, labels_of(spark, []), ["doc_id"]).collect()
    assert len(s) == 11 and all(0 <= r["__score"] <= 1 for r in s)
    only_held_out = docs_of([(i, "a b") for i in range(200) if __import__("zlib").crc32(str(i).encode()) % 10 == 0])
    rows = lm.score(only_held_out).collect()
    assert rows and all(r.train_tokens == 0 == r.n_known and math.isfinite(r.score) for r in rows)


def test_keep_one(edge, docs_of):
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 4, 6, 7, 8, 9]
    two = docs_of([(1, "one text of its own"), (1, "another that shares its id"), (1, "one text of its own")])
    assert sorted(r.text for r in simhash.keep_one(two).collect()) == ["another that shares its id", "one text of its own"]


def test_vantage_trees_lose_no_link():
    rng = np.random.default_rng(5)
    points = rng.integers(0, 1 << 63, 3000, np.uint64) << np.uint64(1)
    near = points[:600] ^ (np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64))
    clump = points[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))
    points = np.unique(np.concatenate((points, near, clump)))
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(np.bitwise_count(points[:, None] ^ points[None]) <= 4, 1)))}
    for levels in (0, 3, 6):
        tree = simhash.build_tree(points[rng.integers(0, len(points), 200)], levels)
        met, homes = set(), np.zeros(len(points), int)
        for _, own, ghosts in simhash.route(tree, points, 4):
            homes[own] += 1
            every = np.concatenate((own, ghosts))
            if len(own):
                a, b = np.nonzero(np.bitwise_count(points[own][:, None] ^ points[every][None]) <= 4)
                met |= {tuple(sorted((int(own[x]), int(every[y])))) for x, y in zip(a, b) if own[x] != every[y]}
        assert met == want and (homes == 1).all()
    label = simhash.forest(points, len(points), 4)
    brute = simhash.unite(np.arange(len(points)), *map(np.array, zip(*want)))
    assert (label == brute).all()


def test_leaves_follow_the_points():
    rng = np.random.default_rng(1)
    points = rng.integers(0, 1 << 63, 60_000, np.uint64) * np.uint64(2) + rng.integers(0, 2, 60_000).astype(np.uint64)
    for levels in (6, 9):
        tree = simhash.build_tree(points[: 64 << levels], levels)
        sizes = np.zeros(1 << levels, int)
        for shard, own, _ in simhash.route(tree, points, 4):
            sizes[shard] += len(own)
        assert (tree["threshold"] < 0).sum() == 1 << levels and sizes.sum() == len(points) and sizes.max() < 5 * len(points) / (1 << levels)


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1002), (5, 5)]
    roots = {r.node: r.root for r in simhash.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert {roots[i] for i in range(201)} == {0} and {roots[i] for i in (1000, 1001, 1002)} == {1000}
    assert simhash.components(spark.createDataFrame([], "u long, v long")).isEmpty()
    with pytest.raises(RuntimeError):
        simhash.components(spark.createDataFrame(chain, "u long, v long"), max_rounds=1)


def test_components_of_few_links(spark, docs_of, monkeypatch):
    """One task joins few links as the rounds do, for nodes of any kind; near dedup's driver then sees no rounds."""
    from panelwright.llm import nearcopies

    rng = np.random.default_rng(3)
    node = "struct<lost:boolean,first:string,u:bigint>"
    names = [(False, x, int(k)) for x in ("", "a", "B", "é", "\U00010000", "\uffff", "ab") for k in range(-6, 6)] + [(True, None, k) for k in range(-6, 6)]
    for kind, some in (("long", list(range(-50, 50))), ("string", [x + str(k) for _, x, k in names[:84]]), (node, names)):
        pairs = [(some[a], some[b]) for a, b in rng.integers(0, len(some), (len(some) // 2, 2))]
        edges = spark.createDataFrame(pairs, f"u {kind}, v {kind}")
        want = sorted(map(str, simhash.components(edges).collect()))
        assert len(want) > 20 and sorted(map(str, simhash.components(edges, few=1000).collect())) == want
        assert sorted(map(str, simhash.components(edges, few=3).collect())) == want
    assert simhash.components(spark.createDataFrame([], "u long, v long"), few=9).isEmpty()
    rounds, one = [], nearcopies.components
    monkeypatch.setattr(nearcopies, "components", lambda edges, **k: rounds.append("MapInArrow" in (got := one(edges, **k))._jdf.queryExecution().toString()) or got)
    base = "one two three four five six seven eight nine ten eleven twelve"
    assert sorted(r.doc_id for r in nearcopies.keep_one(docs_of([(3, base), (1, base.upper()), (2, base + " more"), (7, "another text")])).collect()) == [1, 7]
    assert rounds == [True, True]


def test_classifier_driver_memory(spark, sf, docs_of):
    """The driver holds the features of labelled rows as numbers, not as lists of objects."""
    docs = docs_of([(k, f"word{k % 7} and word{k % 11} of a text") for k in range(6000)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(6000)], "doc_id long, quality int")
    classifier.fit(docs, labels)  # imports and caches
    tracemalloc.start()
    try:
        classifier.fit(docs, labels)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 6000 * 131 * 8 * 4, most


def test_hilbert_is_one_walk():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = packing.hilbert(grid, 3)
    assert sorted(key) == list(range(512)) and (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_tokens_are_exact():
    from tokenizers import Tokenizer

    from panelwright.llm.tokens import WordTokenizer, vocabulary

    import random

    rnd, letters = random.Random(1), "abAB éÉßİıſµªº.,'’…0١\n\t́̇<|>\x85\xa0"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(1500)] + ["a<|endoftext|>B", "A<|ENDOFTEXT|>", "", "it's 12.5% don't."]
    whole, own = Tokenizer.from_file(vocabulary()), WordTokenizer(vocabulary())
    for t, ids in zip(texts, own.ids([t.encode() for t in texts])):
        assert whole.encode(t, add_special_tokens=False).ids == np.frombuffer(ids, "<u2").tolist(), t


def test_gif_round_trip():
    rng = np.random.default_rng(2)
    for bits, n in ((8, 0), (8, 1), (8, 50_000), (2, 9999), (4, 20_000)):
        data = rng.integers(0, 1 << bits, n).astype(np.uint8).tobytes() + bytes(n)
        assert gif.lzw_decode(gif.lzw_encode(data, bits), bits, len(data)) == data
    palette = rng.integers(0, 256, (200, 3)).astype(np.uint8)
    frames = [gif.Frame(rng.integers(0, 200, (5, 7)), 1, 2, 70, k % 4, 3 if k % 2 else None, palette[:16] if k == 2 else None) for k in range(4)]
    frames[2].indices %= 16
    back = gif.decode(gif.encode(gif.Image(9, 8, palette, 0, frames)))
    for a, b in zip(frames, back.frames):
        assert (a.indices == b.indices).all() and (a.left, a.top, a.delay_ms, a.disposal, a.transparent) == (b.left, b.top, b.delay_ms, b.disposal, b.transparent)


def test_gif_against_another_decoder():
    image = pytest.importorskip("PIL.Image")
    data = b"some text, some text again; " * 400
    kept = gif.store(gif.payload(data))
    film = image.open(io.BytesIO(kept))
    assert film.n_frames == len(gif.decode(kept).frames)


def test_gif_disposal():
    one, two = np.zeros((2, 2), int), np.ones((1, 1), int)
    palette = np.array([[10, 20, 30], [200, 0, 0]], np.uint8)
    shown = lambda d, t=None: list(gif.canvases(gif.Image(2, 2, palette, 0, [gif.Frame(one), gif.Frame(two, 0, 0, 0, d, t), gif.Frame(two, 1, 1)])))[-1]
    assert shown(1)[0, 0].tolist() == [200, 0, 0, 255] and shown(2)[0, 0].tolist() == [0, 0, 0, 0] and shown(3)[0, 0].tolist() == [10, 20, 30, 255]
    assert shown(1, 1)[0, 0].tolist() == [10, 20, 30, 255]
    assert not list(gif.decode(gif.encode(gif.Image(1, 1, palette))).frames)


def test_decoded_frames(spark):
    whole = gif.encode(gif.Image(2, 1, np.array([[0, 0, 0], [255, 255, 255]], np.uint8), 0, [gif.Frame(np.array([[0, 1]]), delay_ms=50), gif.Frame(np.array([[1, 1]]), delay_ms=30)]))
    rows = gif.decode_frames(spark.createDataFrame([(1, bytearray(whole)), (2, bytearray(b"no")), (3, None), (4, bytearray(whole[:40]))], "doc_id long, media binary")).collect()
    one = [r for r in rows if r.doc_id == 1]
    assert [(r["index"], r.start_ms, r.histogram[0], r.histogram[63]) for r in one] == [(0, 0, 1, 1), (1, 50, 0, 2)]
    assert {r.doc_id for r in rows if r.error} >= {2, 3}


def test_cut_and_broken_films(spark):
    """Good frames first, then one row with an error."""
    palette = np.array([[0, 0, 0], [255, 255, 255]], np.uint8)
    whole = gif.encode(gif.Image(4, 2, palette, 0, [gif.Frame(np.full((2, 4), k % 2), delay_ms=50) for k in range(3)]))
    second = whole.index(b"\x21\xf9", whole.index(b"\x21\xf9") + 1)
    code_size = whole.index(b"\x2c") + 10
    huge = whole[:6] + b"\xff\xff\xff\xff" + whole[10:]
    films = {1: whole, 2: whole[: second + 20], 3: whole[:second], 4: whole[:code_size] + b"\xc8" + whole[code_size + 1 :], 5: huge, 6: whole[:8], 7: b"", 8: whole[:-1], 9: whole[:second] + b"\x07" + whole[second:]}
    rows = gif.decode_frames(spark.createDataFrame([(k, bytearray(v)) for k, v in films.items()], "doc_id long, media binary")).collect()
    good = {k: [r["index"] for r in rows if r.doc_id == k and r.error is None] for k in films}
    assert good == {1: [0, 1, 2], 2: [0], 3: [0], 4: [], 5: [], 6: [], 7: [], 8: [0, 1, 2], 9: [0]}
    assert {k: sum(r.doc_id == k and r.error is not None for r in rows) for k in films} == {k: int(k != 1) for k in films}


def test_films_use_the_format():
    """Payloads read back through palettes, transparency and disposal, by a plain composer as well."""
    rng = np.random.default_rng(3)
    for data in (b"one line of text; " * 400, bytes(range(256)) * 60, rng.integers(0, 256, 192 * 21).astype(np.uint8).tobytes(), b""):
        data = gif.payload(data)
        kept = gif.store(data)
        image = gif.decode(kept)
        assert b"".join(s[..., 0].tobytes() for _, s in gif.restored(kept)) == data
        assert len({tuple(c) for c in image.palette.tolist()}) == 256 and all(f.disposal == 1 for f in image.frames)
        canvas, out = np.zeros((image.height, image.width), int), b""
        for f in image.frames:
            for y, row in enumerate(f.indices.tolist()):
                for x, sample in enumerate(row):
                    if sample != f.transparent:
                        canvas[y, x] = image.palette[sample][0]
            out += canvas[: len(f.indices)].astype(np.uint8).tobytes()
        assert out == data
    assert any(f.transparent is not None for f in gif.decode(gif.store(gif.payload(b"one line of text; " * 400))).frames)


def test_escapes(spark):
    texts = ["<|im_end|>", r"<\|im_end|>", r"<\\|x", "<", "|", "", r"\n", "a\\", "<|<|", "<\n|"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", chat.unescape(chat.escape(F.col("t"))).alias("u"), chat.unescape_role(chat.escape_role(F.col("t"))).alias("r"), chat.escape(F.col("t")).alias("e"), chat.escape_role(F.col("t")).alias("er")
    )
    for r in df.collect():
        assert r.t == r.u == r.r and "<|" not in r.e and "\n" not in r.er


def test_reply_trees(spark):
    # 1 > 2 > 4 and 1 > 3; 5 is a root of its own; 7's parent does not exist
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "a", 1.0), ("t", 3, 1, "assistant", "b", 5.0), ("t", 4, 2, "user", "c", 1.0), ("u", 5, None, "user", None, None), ("t", 7, 99, None, "z", 0.5)]
    nodes = spark.createDataFrame(rows, "tree_id string, node_id long, parent_id long, role string, text string, score double")
    best = {r.tree_id: r for r in chat.format_paths(nodes).collect()}
    assert best["t"].leaf_id == 3 and best["t"].formatted == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n" and best["u"].n_turns == 1
    three = {(r.tree_id, r["rank"]): r.leaf_id for r in chat.format_paths(nodes, top=3).collect()}
    assert three == {("t", 1): 3, ("t", 2): 4, ("t", 3): 7, ("u", 1): 5}
    assert chat.format_paths(nodes.limit(0)).isEmpty()


def test_cycles_and_repeated_rows(spark):
    """1 and 2 are a cycle, 3 and 4 hang from it, 5 is its own parent with 6 below, 7 > 8 is a path; node 8 stands twice, one row has no node id."""
    edges = [(1, 2), (2, 1), (3, 1), (4, 3), (5, 5), (6, 5), (7, None), (8, 7), (8, 7), (None, 7)]
    rows = [("t", n, p, "user", f"{n}", 1.0) for n, p in edges] + [("t", 8, 7, "user", "another", 0.0)] + [(None, 1, None, None, None, None)] * 2 + [("c", k, k % 30 + 1, "user", "x", 1.0) for k in range(1, 31)] + [("c", 50, 1, "user", "x", 1.0)]
    nodes = spark.createDataFrame(rows, "tree_id string, node_id long, parent_id long, role string, text string, score double")
    got = {(r.tree_id, r["rank"]): r for r in chat.format_paths(nodes, top=5).collect()}
    assert set(got) == {("t", 1), (None, 1)} and got["t", 1].leaf_id == 8 and got["t", 1].n_turns == 2 and got[None, 1].n_turns == 1
    paths = chat.chosen_paths(chat.single(nodes), top=5)
    assert paths.count() == 3


@pytest.mark.parametrize("kind", ["edge", "clash", "empty"])
def test_chats_on_edges(kind, edge, clash):
    docs = {"edge": edge, "clash": clash, "empty": edge.limit(0)}[kind].withColumnRenamed("source", "role").withColumnRenamed("doc_id", "conv_id").withColumn("turn", F.lit(None).cast("long"))
    chats = chat.format_paths(chat.linear_trees(docs), train_role="s")
    rows = {r.tree_id: r for r in chats.select("tree_id", "n_turns", chat.read_back(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert len(rows) == (0 if kind == "empty" else 10)
    if kind != "empty":
        assert rows[6].n_turns == 2 and rows[1].loss == [""] and rows[None].turns[0].text == "text of no document"
        assert {i: rows[i].loss for i in (3, 7, 8, 9)} == {r.conv_id: [r.text] for r in docs.where("conv_id IN (3, 7, 8, 9)").collect()}


def test_deep_tree(spark):
    n = 700
    nodes = spark.range(n).selectExpr("1L AS tree_id", "id AS node_id", "IF(id > 0, id - 1, NULL) AS parent_id", "'user' AS role", "CAST(id AS STRING) AS text", "0.0D AS score")
    r = chat.format_paths(nodes).select("n_turns", chat.read_back(F.col("formatted")).alias("t")).first()
    assert r.n_turns == n and [x.text for x in r.t] == [str(i) for i in range(n)]


def test_mix_copies(docs_of):
    docs = docs_of([(i, "w " * (i % 7 + 1), "en", f"s{i % 3}") for i in range(90)] + [(200, None, None, None)])
    mixed = mixing.mix(docs)
    taken = {r.doc_id: r.taken for r in mixed.collect()}
    rows = mixing.apply_mix(mixed)
    assert {r.doc_id: r.n for r in rows.groupBy("doc_id").agg(F.sum(F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), " "), ""))).alias("n")).collect()} == {k: v for k, v in taken.items() if v or k == 200}


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs, sizes = table(spark, sf, "documents"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        assert k == 4 or out.columns == columns
        docs = out.checkpoint()
        sizes.append(docs.count())
    assert 200 >= sizes[0] >= sizes[1] == sizes[2] > 0
    assert corpus_pipeline.run(spark, sf).count() == sizes[-1]
    empty = table(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).isEmpty()


def test_large_blocks_in_tiles(docs_of, monkeypatch):
    """Every link is found, whatever the sides of tiles and the bound on pairs are: against all pairs."""
    from panelwright.llm import nearcopies

    rng = np.random.default_rng(12)
    base = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(220)]
    texts = []
    for k in range(150):
        words, changes = list(base), rng.integers(2, 14)
        for at in rng.choice(len(words), changes, replace=False):
            words[at] = "".join(rng.choice(list("abcdefgh"), 6))
        texts.append(" ".join(words))
    sets = [nearcopies.shingles(nearcopies.normal(t.encode()), 5) for t in texts]
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if nearcopies.jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((want[i], want[j]))
                want = [a if x == b else x for x in want]
    assert 1 < len(set(want)) < len(texts)
    for small, tile in ((4, 16), (32, 256), (1000, 256)):
        monkeypatch.setattr(nearcopies, "SMALL", small)
        monkeypatch.setattr(nearcopies, "TILE", tile)
        assert sorted(r.doc_id for r in nearcopies.keep_one(docs_of(list(enumerate(texts)))).collect()) == sorted(set(want))


def test_pipeline_drops_near_copies(spark, sf, docs_of):
    """Similarities on both sides of 0.8, a chain, repeated ids with texts of their own, and rows without an id."""
    import corpus_pipeline

    rng = np.random.default_rng(6)
    say = lambda n: ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n)]
    rows, stay = [], []
    for k in range(20):
        base, at = say(300), 100 * (k + 1)
        step = lambda t, where: t[:where] + say(1) + t[where + 1 :]
        one = base
        for w in range(10, 60, 10):  # 5 of 296 shingles a change: 0.84 after five
            one = step(one, w)
        two = one
        for w in range(100, 150, 10):  # 0.84 to one, 0.71 to the base
            two = step(two, w)
        far = base
        for w in range(20, 280, 20):  # 13 changes: 0.64
            far = step(far, w)
        rows += [(at, " ".join(base)), (at + 1, " ".join(one)), (at + 2, " ".join(two)), (at + 3, " ".join(far)), (None, " ".join(two))]
        stay += [at, at + 3]
    rows += [(7, "one text of its own here"), (7, "another text under the same id"), (7, "One text  of its own here"), (None, "no id at all"), (None, "no id at all")]
    kept = corpus_pipeline.near_dedup(spark, docs_of(rows), sf).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [7, 7, *stay]
    assert len({r.text.lower() for r in kept if r.doc_id == 7}) == 2
    assert [r.text for r in kept if r.doc_id is None] == ["no id at all"]


def test_near_dedup_goes_through_vantage_points(spark, sf, docs_of, monkeypatch):
    """Texts whose fingerprints are within four bits, though their similarity is below 0.8, are copies of the stage; others stay."""
    import corpus_pipeline
    from panelwright.llm import nearcopies

    rng, rows, far = np.random.default_rng(8), [], 0
    close = lambda a, b: int.from_bytes(simhash.fingerprint(a.encode())) ^ int.from_bytes(simhash.fingerprint(b.encode()))
    while len(rows) < 8:
        words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(40)]
        # a passage that occurs twice weighs more in a fingerprint than in a set
        one = " ".join(words[:8] * 12 + words)
        two = " ".join(words[:8] * 12 + words[:20] + words[30:])
        sets = [nearcopies.shingles(nearcopies.normal(t.encode()), 5) for t in (one, two)]
        if nearcopies.jaccard(*sets) < 0.8 and close(one, two).bit_count() <= 4:
            rows += [(len(rows), one), (len(rows) + 1, two)]
        else:
            far += 1
            assert far < 1000
    calls, links = [], nearcopies.alike
    monkeypatch.setattr(nearcopies, "alike", lambda *a: calls.append(a) or links(*a))
    docs = docs_of([*rows, (100, "a text of its own that has no copy here")])
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()) == [0, 2, 4, 6, 100] and len(calls) == 1
    assert nearcopies.keep_one(docs).count() == 9


def test_words_dealt_by_arrow():
    from panelwright.llm.common import dealt_words

    texts = [b"", b" \n", b" a b a", b"a\x0b\x0cb\t\r\n", b"c\x1cd \xc2\x85 e\x00f", "é x  y".encode(), b"one"]
    for some in (texts, texts[2:3], texts[:2], []):
        words, index, size = dealt_words(some)
        found = [words[i].as_py() for i in index.tolist()]
        assert found == [w for t in some for w in t.split()] and size.tolist() == [len(t.split()) for t in some]
        assert len(set(words.to_pylist())) == len(words) and b"" not in words.to_pylist()


def test_word_codes_by_table():
    words = [b"a", b"bc", b"xyz", b"\n", "é".encode(), b"unseen", b"z"]
    head = lm.Head({w: k for k, w in enumerate(words[:5])}, np.arange(5, 0, -1), 2, np.ones(18), 15, 5)
    rank, cls = head.coded(pa.array(words, pa.binary()))
    assert ((rank + 1) * head.classes + cls).tolist() == [head.codes()[w] for w in words]


def test_chunks_of_letters_digits_and_marks_skip_the_tokenizer(monkeypatch):
    from panelwright.llm import tokens

    made = tokens.WordTokenizer(tokens.vocabulary())
    texts = ["Été$$$ abc%%% a-b_c.24@mail1.example.com https://x.org/?q=1&r=2 12,500.00 ÀÉ### (so) e=mc2!", "don't 's it's a'b <|endoftext|> <|x 中文 ½ é"]
    want = [np.array(made.full.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    whole, learn = [], made._learn_whole
    monkeypatch.setattr(made, "_learn_whole", lambda found: whole.extend(found) or learn(found))
    assert made.ids([texts[0].encode()]) == want[:1] and not any(c.isalpha() for w in whole for c in w)
    assert made.ids([t.encode() for t in texts]) == want
