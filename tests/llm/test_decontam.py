import random
import re

from tests.llm.helpers import docs, with_clashes
from tidewright.llm import decontam

ITEMS = "item_id long, text string"


def brute(text, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    d, hit, found = words(text), set(), set()
    for i, t in items:
        w = words(t)
        k = min(window, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            for p in range(len(d) - k + 1):
                if d[p : p + k] == w[a : a + k]:
                    hit.update(range(p, p + k))
                    found.add(i)
    return len(d), hit, found


def test_random_texts_equal_brute_force(spark):
    rng = random.Random(3)
    vocab = ["a", "b", "c", "É"]
    text = lambda n: rng.choice([" ", ", "]).join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 3, 5, 9, 10, 11, 14]))) for i in range(12)] + [(100, None), (3, text(6))]
    texts = [text(rng.randint(0, 60)) for _ in range(60)] + [None, "", items[4][1], items[4][1]]
    for window in (3, 10):
        got = decontam.find_leaks(docs(spark, texts), spark.createDataFrame(items, ITEMS), window=window, block_words=20).orderBy("doc_id").collect()
        for r, t in zip(got, texts, strict=True):
            n, hit, found = brute(t, items, window)
            spans = {p for a, b in r["leaks"]["spans"] for p in range(a, b)}
            assert (r["leaks"]["n_words"], spans, r["leaks"]["items"]) == (n, hit, sorted(map(str, found))), (t, window)


def test_removal_leaves_no_window(spark):
    item = "one two three four five six seven eight nine ten eleven"
    texts = [f"Clean start. {item.upper()}! and a clean end of the text that goes on for a good while longer than that item", item, "nothing here", None, "", f"one two three four five {item} six seven eight nine ten more words to keep the text alive and well " + "x " * 60]
    df = with_clashes(docs(spark, texts))
    items = spark.createDataFrame([(1, item), (None, "zz yy"), (2, "")], ITEMS)
    got = decontam.remove_leaks(df, items, n_chars="n_chars")
    assert got.columns == df.columns
    rows = {r["doc_id"]: r for r in got.collect()}
    assert set(rows) == {0, 2, 3, 4, 5}
    assert rows[0]["text"] == "Clean start. \n! and a clean end of the text that goes on for a good while longer than that item"
    assert rows[0]["n_chars"] == len(rows[0]["text"]) and rows[2]["text"] == "nothing here" and rows[3]["text"] is None
    assert not brute(rows[5]["text"], [(1, item)])[1]


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b")], ITEMS)
    assert decontam.find_leaks(docs(spark, ["x"]).limit(0), items).count() == 0
    got = decontam.find_leaks(docs(spark, ["x y"]), items.limit(0)).first()["leaks"]
    assert (got["n_words"], got["spans"], got["items"]) == (2, [], [])


def test_cut_words_keeps_the_rest():
    assert decontam.cut_words("a, b; c d", [(1, 3)]) == "a, \n d"
    assert decontam.cut_words("é b", [(0, 2)]) == "\n"


def test_long_texts_and_many_blocks(spark):
    """More blocks than stay in memory, and a text longer than a chunk."""
    items = [(i, " ".join(f"w{i}x{k}" for k in range(12))) for i in range(8)]
    long = "filler " * 400_000 + items[3][1] + " tail"
    table = spark.createDataFrame(items, ITEMS)
    got = decontam.find_leaks(docs(spark, [long, items[5][1], long]), table, block_words=12).orderBy("doc_id").collect()
    assert [r["leaks"]["items"] for r in got] == [["3"], ["5"], ["3"]]
    assert got[0]["leaks"]["spans"] == [[400_000, 400_012]] and got[0]["leaks"]["n_words"] == 400_013
    kept = decontam.remove_leaks(docs(spark, [long, items[5][1], "clean"]), table, block_words=12).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in kept] == [0, 2] and kept[0]["text"] == "filler " * 400_000 + "\n tail"
