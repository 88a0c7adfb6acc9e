import random

from sextant.llm.token_counts import LEAF, Encoder, Tree, apply_edits, edited, read_ranks, revision, trees

RANKS = read_ranks()


def test_edits_equal_full_encoding():
    encoder, rnd = Encoder(RANKS), random.Random(7)
    bits = ["a", "word", " the", "  ", "\n", "'s", "'", "12", "!?", "é", " ", "🙂", "longerword", " \n ", "\t"]
    for _ in range(60):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 900)))
        tree = Tree.of(text, encoder)
        for _ in range(25):
            at, deleted = rnd.randrange(-2, len(text) + 3), rnd.choice([0, 0, 1, 3, 40, 700])
            text, again = tree.edit(text, at, deleted, "".join(rnd.choice(bits) for _ in range(rnd.choice([0, 1, 3, 30, 400]))), encoder)
            pieces = encoder.find(text)
            assert tree.total.tolist() == [len(text), len(pieces), len(encoder.bpe.encode_ordinary(text))]
            assert tree.to_bytes() == Tree.from_bytes(tree.to_bytes()).to_bytes()
            assert (tree.sums[1 : tree.width] == tree.sums[2 : 2 * tree.width : 2] + tree.sums[3 : 2 * tree.width : 2]).all()


def test_an_edit_reencodes_little():
    encoder = Encoder(RANKS)
    text = "some words here. " * 20_000
    tree = Tree.of(text, encoder)
    text, again = tree.edit(text, 170_000, 3, "other", encoder)
    assert again <= 4 * LEAF and tree.total[2] == len(encoder.bpe.encode_ordinary(text))


def test_tables(spark):
    encoder = Encoder(RANKS)
    rows = [(1, "Hello world, it's fine.", 9), (2, None, 9), (3, "", 9), (4, "x " * 30_000, 9), (None, "a", 9), (5, "same", 9), (5, "same", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tree int")
    built = trees(df)
    n = lambda t: len(encoder.bpe.encode_ordinary(t or ""))
    assert {r.doc_id: r.n_tokens for r in built.collect()} == {i: n(t) for i, t, _ in rows if i}
    edits = spark.createDataFrame([(1, 1, 5, 6, " there"), (1, 2, None, None, "Oh! "), (2, 1, 3, 4, "new text"), (9, 1, 0, 0, "lost")], "doc_id long, seq int, at int, deleted int, inserted string")
    got = {r.doc_id: (r.text, r.n_tokens) for r in apply_edits(built, edits).collect()}
    assert got == {i: (t, n(t)) for i, t in [(1, "Oh! Hello there, it's fine."), (2, "new text"), (3, ""), (4, rows[3][1]), (5, "same")]}
    out = edited(trees(revision(df), edits="edits")).collect()
    assert {r.doc_id: r.n_tokens for r in out} == {r.doc_id: n(r.text) for r in out} and len(out) == 5
    assert trees(df.limit(0)).collect() == []
