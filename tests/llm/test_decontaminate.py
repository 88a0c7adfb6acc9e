import random
import re

import duckdb

from sextant.llm.decontaminate import UNITS, contaminated

ITEMS = [
    (1, "A train leaves London at 7 hours and Anna waits 15 minutes before Anna walks 3 km to the old red market place"),
    (2, "The quick brown fox jumped over nine lazy dogs near the frozen river bank at dawn today"),
    (3, "short item here"),
    (4, None),
    (5, " "),
]


def run(spark, docs, items=ITEMS, **options):
    d = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, item_ids int")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {r.doc_id: (r.item_ids, r.kept) for r in contaminated(d, b, **options).collect()}


def test_templates(spark):
    docs = [
        (1, "noise before " + ITEMS[0][1] + " noise after"),
        (2, "Q: a train leaves Paris at 9 days and Boris waits 44 seconds before Boris walks 8 miles to the old red market place."),  # new values, consistent
        (3, "a train leaves Paris at 9 days and Boris waits 44 seconds before Clara walks 8 miles to the old red market place."),  # one name, two values
        (4, "The QUICK brown, fox jumped over nine lazy dogs near the frozen"),
        (5, "the quick brown fox jumped over nine sleepy dogs near the frozen"),
        (6, "well a short item here too"), (7, None), (8, ""), (9, "7 8 9 10 11 12 13 14 15 16 17 18"),
        (10, "word " * 50_000 + ITEMS[1][1]),
    ]
    for block in (1 << 20, 40):
        got = run(spark, docs, block=block)
        assert {i for i, (_, kept) in got.items() if not kept} == {1, 2, 3, 4, 6, 10}
        assert [got[i][0] for i in (1, 2, 4, 6, 10)] == [[1], [1], [2], [3], [2]]
    strict = run(spark, docs, least=6)
    assert {i for i, (_, kept) in strict.items() if not kept} == {1, 2, 6, 10}
    assert run(spark, []) == {}
    assert run(spark, docs, items=[])[1] == ([], True)
    assert set(run(spark, [(None, "x"), (1, "a"), (1, "a")])) == {1}


def test_planted_passages(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(rnd.randrange(15, 40)))) for i in range(30)]
    docs, truth = [], {}
    for i in range(200):
        w = [word() for _ in range(rnd.randrange(0, 200))]
        hit = [rnd.randrange(30)] if i % 3 == 0 else []
        for k in hit:
            w[len(w) // 2 : len(w) // 2] = items[k][1].upper().split() if i % 2 else items[k][1].split()
        docs.append((i, "\n".join(w)))
        truth[i] = (hit, not hit)
    assert run(spark, docs, items) == truth


def test_finds_what_plain_search_finds(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id for r in contaminated(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")).filter("not kept").collect()}
    want = {r[0] for r in duckdb.sql(f"select distinct doc_id from '{sf}/documents.parquet' d, '{sf}/benchmark.parquet' b where contains(d.text, b.text)").fetchall()}
    assert want and got == want


def test_copies_in_capitals_and_of_numbers(spark):
    items = [
        *ITEMS[:2],
        (6, "On day 1 we sold 12 34 56 78 90 11 22 33 44 55 66 77 pears"),
        (7, "Ask Anna Berg Carl Dahl Emma Falk Gina Holm Ivar Jons Karl Lund"),
        (8, "Ask Maria 12 34"),
    ]
    docs = [
        (1, "before " + ITEMS[0][1].upper() + " after"), (2, "before " + ITEMS[1][1].upper()), (3, "before " + ITEMS[1][1].title()),
        (4, "before " + items[2][1] + " after"), (5, "before " + items[3][1]), (6, "see: ask MARIA 12 34."),
        (7, "before On day 1 we sold 12 34 56 78 91 11 22 33 44 55 66 77 pears"),  # a number differs in every window
        (8, "ASK BORIS 12 34"), (9, "THE QUICK BROWN FOX JUMPED OVER NINE LAZY DOGS"),
    ]
    for block in (1 << 20, 40):
        got = run(spark, docs, items, block=block)
        assert {i: ids for i, (ids, _) in got.items()} == {1: [1], 2: [2], 3: [2], 4: [6], 5: [7], 6: [8], 7: [], 8: [], 9: []}


WORDS = ["red", "old", "tree", "runs", "over", "the", "market", "and", "small", "stone"]


def canonical(text):
    """(kind, value) of each word by the rules of the module, in plain Python; ASCII only."""
    out, opens, after_number = [], True, False
    for m in re.finditer(r"[^\x20\x09-\x0D]+|\n", text):
        raw = m.group()
        if raw == "\n":
            opens = True
            continue
        core = re.search(r"[A-Za-z0-9](.*[A-Za-z0-9])?", raw)
        if not core:
            opens = opens or bool(re.search(r"[.!?:]", raw))
            continue
        opens = opens or bool(re.search(r"[.!?:]", raw[: core.start()]))
        word, low = core.group(), core.group().lower()
        kind = 1 if word[0].isdigit() else 2 if word[0].isupper() and not opens else 3 if low in UNITS.split() and after_number else 0
        out.append((kind, low))
        opens, after_number = bool(re.search(r"[.!?:]", raw[core.end() :])), kind == 1
    return out


def plain_hit(doc, item, window=10):
    d, b = canonical(doc), canonical(item)
    for size in {min(window, len(b)), min(2 * window, len(b))}:
        for y in (b[q : q + size] for q in range(len(b) - size + 1)):
            own = sum(k == 0 for k, _ in y)
            enough = 2 * own >= size if size == window else own >= min(2, (size + 1) // 2) if size < window else own >= 2 and 2 * own < size
            for p in range(len(d) - size + 1):
                x = d[p : p + size]
                if size <= window and [v for _, v in x] == [v for _, v in y]:
                    return True
                if not enough or any(j != k or (j == 0 and v != w) for (j, v), (k, w) in zip(x, y)):
                    continue
                pairs = {(k, v, w) for (k, v), (_, w) in zip(x, y) if k}
                if len({(k, v) for k, v, _ in pairs}) == len({(k, w) for k, _, w in pairs}) == len(pairs):
                    return True
    return False


def test_templates_and_slots_against_brute_force(spark):
    rnd = random.Random(21)

    def word():
        x = rnd.random()
        return str(rnd.randrange(3)) if x < 0.2 else rnd.choice(["Anna", "Berg", "Carl"]) if x < 0.4 else rnd.choice(["km", "days"]) if x < 0.5 else rnd.choice(WORDS) + rnd.choice(["", "", "", ",", ".", "\n"])

    items = [(i, " ".join(word() for _ in range(rnd.choice([3, 8, 10, 11, 14])))) for i in range(40)]
    docs = []
    for i in range(300):
        base = items[rnd.randrange(40)][1].split(" ")
        for _ in range(rnd.randrange(4)):
            k = rnd.randrange(len(base))
            base[k] = word()
        docs.append((i, " ".join([*(word() for _ in range(rnd.randrange(6))), *base, *(word() for _ in range(rnd.randrange(6)))])))
    want = {i: any(plain_hit(t, x) for _, x in items) for i, t in docs}
    assert 60 < sum(want.values()) < 290
    for block in (1 << 20, 10):
        assert {i: not kept for i, (_, kept) in run(spark, docs, items, block=block).items()} == want


def test_verbatim_copies_of_slot_heavy_items(spark):
    items = [(1, "Compute 3 4 5 6 7 8 9"), (2, "Add 12 km 5 m 7 cm"), (3, "Sum of 1 2 3 4 5 6 7 8 9 10 11 12")]
    docs = [(i, f"before {t} after") for i, t in items] + [(4, "Compute 3 4 5 6 7 8 8"), (5, "Sum of 1 2 3 4 5 6 7 9 9 10 11 12")]
    assert {i: ids for i, (ids, _) in run(spark, docs, items).items()} == {1: [1], 2: [2], 3: [3], 4: [], 5: []}


def test_frame_shared_by_thousands_of_items(spark):
    frame = "what is the largest city in the whole country of"
    items = [(i, f"{frame} Land{i} and who was its number {i} mayor") for i in range(10_000)]
    docs = [(i, f"{frame} Place{i} and who was its number 5 mayor. more") for i in range(200)] + [(900, "what is the largest city here")]
    got = run(spark, docs, items)
    assert sum(not kept for _, kept in got.values()) == 200 and got[900] == ([], True)
    assert all(1 <= len(ids) <= 20 for i, (ids, kept) in got.items() if not kept)


def test_slot_heavy_item_with_new_values(spark):
    items = [(1, "Add 3 km and 4 km and 5 km then 6 km total"), (2, "Take 1 m then 2 m")]
    docs = [
        (1, "Add 13 km and 14 km and 15 km then 16 km total"), (2, "Add 13 km and 13 km and 15 km then 16 km total"), (3, "see: take 8 days then 9 days."),
        (4, "Add 13 km and 14 km and 15 km plus 16 km in all"), (5, "take 8 m then 8 m"), (6, "13 km 14 km 15 km 16 km 17 km 18 km"),
    ]
    assert {i: ids for i, (ids, _) in run(spark, docs, items).items()} == {1: [1], 2: [], 3: [2], 4: [], 5: [], 6: []}


def test_shared_frames_and_equal_items(spark):
    frame = "what is the name of the largest known living tree that"
    items = [(1, f"{frame} stands near the northern lake shore"), (2, f"{frame} grows by a quiet southern sea bay"), (3, f"{frame} grows by a quiet southern sea bay"), (4, f"{frame} fell")]
    docs = [(1, "so " + items[1][1]), (2, items[0][1]), (3, frame + " burned"), (4, items[3][1])]
    # 2 and 3 are equal: the smaller names them; the frame alone is named by the smallest item of all
    assert {i: ids for i, (ids, _) in run(spark, docs, items).items()} == {1: [2], 2: [1], 3: [1], 4: [4]}
    from sextant.llm.decontaminate import window_links, window_members

    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    pairs = window_links(d, b).join(window_members(b), ["key", "whole", "slots"]).select("doc_id", "item_id").distinct().collect()
    assert {tuple(r) for r in pairs} == {(i, k) for i in range(1, 5) for k in range(1, 5)}


def test_capitals_of_other_scripts(spark):
    items = [(1, "быстрая лиса прыгает через ленивую собаку у старой реки утром"), (2, "η γρήγορη αλεπού πηδάει πάνω από το τεμπέλικο σκυλί σήμερα"), (3, "İstanbul'da bugün hava çok güzel ve deniz de çok sakin")]
    docs = [(i, "так: " + t.upper() if i < 3 else t) for i, t in items] + [(4, "БЫСТРАЯ ЛИСА")]
    assert {i: ids for i, (ids, _) in run(spark, docs, items).items()} == {1: [1], 2: [2], 3: [3], 4: []}


def test_items_of_a_word_or_two(spark):
    items = [(1, "yes"), (2, "oh no"), (3, "say it now")]
    docs = [(1, "yes and oh no"), (2, "just say it now")]
    assert {i: ids for i, (ids, _) in run(spark, docs, items).items()} == {1: [], 2: [3]}
    assert run(spark, docs, items, shortest=1)[1] == ([1, 2], False)
