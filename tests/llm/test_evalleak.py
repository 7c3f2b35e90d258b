import random

from tallyforge.llm import evalleak as E

ITEMS = "item_id long, suite string, passage string, question string, answer string, text string"


def words(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(n)]


def brute(item, doc, least=20, edits=6):
    """Whether the document holds 20 words of some stretch of the item with an edit in ten words at most: plain dynamic programming."""
    never = -(10**9)
    for start in range(len(item) - least + 1):
        # held[j][e]: most held words of the stretch so far when it ends before doc[j] with e edits
        held = [[0] + [never] * edits for _ in range(len(doc) + 1)]
        for k, w in enumerate(item[start:], 1):
            new = []
            for j in range(len(doc) + 1):
                row = []
                for e in range(edits + 1):
                    best = held[j][e - 1] if e else never
                    if j:
                        best = max(best, held[j - 1][e] + 1 if doc[j - 1] == w else held[j - 1][e - 1] if e else never, new[j - 1][e - 1] if e else never)
                    row.append(best)
                new.append(row)
            held = new
            if k >= least and max(row[e] for row in held for e in range(min(edits, k // 10) + 1)) >= least:
                return True
    return False


def leaked(passage, doc):
    index = E.EvalIndex()
    index.add(E.words(" ".join(passage)), [1])
    return bool(E.leaks_in(index, [index.vocabulary.get(w, 0) for w in E.words(" ".join(doc))]))


def test_random_edits_against_brute_force():
    rng = random.Random(4)
    seen = [0, 0]
    for n in range(90):
        item = words(n, rng.randrange(20, 46))
        a = rng.randrange(len(item) - 17)
        part = item[a : a + rng.randrange(17, 38)]
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(part))
            part[at : at + 1] = rng.choice([[], ["zzz"], [part[at], "zzz"]])
        doc = words(1000 + n, 3) + part + words(2000 + n, 3)
        want = brute(item, doc)
        assert leaked(item, doc) == want
        seen[want] += 1
    assert min(seen) > 20


def test_longest_runs_and_many_edits_in_a_row():
    item = words(7, 60)
    cut = item[:18] + ["a", "b", "c", "d"] + item[22:42]  # a leak of 40 words only
    assert brute(item, cut) and leaked(item, cut)
    assert not leaked(item, item[:18] + ["a", "b", "c", "d", "e"] + item[23:41])
    template = [w if i not in (5, 9) else f"name{i}" for i, w in enumerate(item[:20])]
    assert not leaked(item, template) and leaked(item, [*template, *item[20:22]])
    long = words(8, 400)
    index = E.EvalIndex()
    index.add(long, [1])
    doc = [w if i % 12 else "zzz" for i, w in enumerate(long)]  # 34 edits: the whole text is one span
    spans = E.leaks_in(index, [index.vocabulary.get(w, 0) for w in doc])[0]
    assert max(b - a for a, b in spans) >= 398


def test_instructions_of_any_length(spark):
    intro = " ".join(f"Rule {i} asks for {' '.join(words(300 + i, 4))}." for i in range(12))
    items = frame(spark, [(n, "s", f"{intro} {' '.join(words(n, 30))}", "q", "a") for n in range(4)])
    docs = spark.createDataFrame([(1, intro), (2, " ".join(words(2, 30)))], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in E.find_leaks(docs, items).collect()] == [(2, 2)]


def test_cleaning_in_the_scan(spark, monkeypatch):
    items = frame(spark, [(n, "s", " ".join(words(n, 25)), "q", "a") for n in range(3)])
    rows = [(1, f"one {' '.join(words(0, 25))} two {' '.join(words(2, 25))} three", "x"), (2, None, "y"), (3, "", None), (4, "plain", "z"), (4, "plain", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    for most in (E.MAX_EVAL_WORDS, 30):
        monkeypatch.setattr(E, "MAX_EVAL_WORDS", most)
        got = E.clean(docs, items)
        assert got.columns == docs.columns
        assert sorted(got.collect(), key=repr) == sorted([(1, "one  two  three", "x"), *rows[1:]], key=repr)


def test_words_ignore_case_markup_spacing_and_labels():
    plain = E.words("Why did Ann keep the ledger at 12:30 on 2025-03-01? Because of rows.")
    assert E.words("**Question:** WHY did\xa0Ann <b>keep</b> the [ledger](http://x.example/a) at 12:30,\\non 2025-03-01?\n\nAnswer: Because – of rows!") == plain
    assert "20250301" in plain and E.words(None) == [] and E.words("  \n") == []


def frame(spark, items):
    return spark.createDataFrame([(i, s, p, q, a, "clash") for i, s, p, q, a in items], ITEMS)


def test_items_documents_instructions_and_spans(spark):
    intro = "Read the note below with care and answer the question at the end using only what the note says, please do."
    passages = [" ".join(words(n, 30)) for n in range(5)]
    items = [(n, "s", f"{intro} {p}", "Why?", "Because.") for n, p in enumerate(passages)]
    items += [(10, "s", passages[0], "x", "y"), (11, "t", None, " ".join(words(50, 14)), " ".join(words(51, 8))), (12, "t", None, None, None), (13, "t", "", "", "")]
    docs = [
        (1, f"before {passages[0].upper()} after"), (2, intro), (3, None), (4, ""), (5, " ".join(words(50, 14)) + "\n" + " ".join(words(51, 8))), (6, "long " * 50_000 + passages[3]),
        (7, " ".join(passages[1].split()[:17])), (8, f"{passages[1]} and {passages[2]}"), (8, f"{passages[1]} and {passages[2]}"),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = E.find_leaks(d, frame(spark, items))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(1, 0), (1, 10), (5, 11), (6, 3), (8, 1), (8, 2)}
    clean = {r["doc_id"]: r["text"] for r in E.without_leaks(d.filter("doc_id < 8"), got).collect()}
    assert clean[1] == "before  after" and clean[2] == intro and clean[3] is None and clean[6].strip("long ") == ""
    assert {r["doc_id"] for r in E.without_leaks(d, got, drop=True).collect()} == {2, 3, 4, 7}


def test_empty_tables_and_blocks(spark, monkeypatch):
    empty = spark.createDataFrame([], "doc_id long, text string")
    items = [(n, "s", " ".join(words(n, 25)), "q", "a") for n in range(6)]
    assert E.find_leaks(empty, frame(spark, items)).count() == 0
    docs = spark.createDataFrame([(n, " ".join(words(n, 25))) for n in range(6)], "doc_id long, text string")
    assert E.find_leaks(docs, frame(spark, [])).count() == 0
    monkeypatch.setattr(E, "MAX_EVAL_WORDS", 40)
    assert {(r["doc_id"], r["item_id"]) for r in E.find_leaks(docs, frame(spark, items)).collect()} == {(n, n) for n in range(6)}
