import random

import pytest

from tallyforge.llm import pairs as P

SCHEMA = "event_id string, user_text string, assistant_text string, request_status string, topical boolean, q string"
TOPICS = [
    ("How do I rotate the key of {}?", "Open the vault and pick {} from the list. Create a new revision first, so that sessions keep working."),
    ("Why did the seat {} pass its quota?", "The seat {} sent many requests in two days, which is far above its normal rate. Most came from one agent."),
    ("Where does {} see the cost of a request?", "Open the detail page of {} and expand the row. The cost is shown next to the tokens that were counted."),
    ("Can {} get an alert before the budget ends?", "Yes, add a threshold to the rule of {}. The alert is sent once per period, even if the value moves."),
    ("How should I read the gap report of {}?", "A gap means that the source {} used a number that never arrived. Wait an hour first, because late batches often close it."),
]
NAMES = "adalo bemira coluth dorgan elvira fandor golmer hastin ilvana jorek".split()
DECLINED = ["I'm sorry, but I cannot help with that. Please ask someone else.", "Unfortunately, this topic stays closed in here.", "With regret, this topic stays closed in here. Please ask someone else."]


def table(seed=1):
    rng = random.Random(seed)
    rows, want = [], {}

    def add(kind, q, a):
        rows.append((f"e{len(rows)}", q, a, "ok", True, "clash"))
        if kind:
            want[rows[-1][0]] = kind

    for i in range(150):
        q, a = rng.choice(TOPICS)
        name = rng.choice(NAMES)
        add(None, q.format(name), rng.choice(["", "Happy to help. ", "I'm not able to look inside, but this is how it works. "]) + a.format(name).rstrip("." if i % 9 == 0 else ""))
    for i in range(36):
        q, _ = TOPICS[i % len(TOPICS)]
        add("refusal", q.format(rng.choice(NAMES)), DECLINED[i % 3])
    q, a = TOPICS[0]
    for bad in (None, "", " ​", "N/A", "```\n```", "(no answer)", "<p></p>", "无", "...", "{}"):
        add("empty", q.format("adalo"), bad)
    for cut in ("Open the vault and pick adalo from the", "Open the vault and pick ada", "Open the vault and pick adalo from the list. Create a new revision first, so that sess", "Use this:\n```sh\nrun --all", "Open the vault (see", "Steps:\n1. Open the list\n2."):
        add("truncated", q.format("adalo"), cut)
    for say in (str, str.upper, lambda s: f"> {s}\n", lambda s: f"So the question is: {s}", lambda s: f"{s}\n\n{s}", lambda s: s.replace("do I", "do you").rstrip("?") + "..."):
        add("copied", q.format("adalo"), say(q.format("adalo")))
    german = "Öffnen Sie den Tresor und wählen Sie adalo aus der Liste. Legen Sie zuerst eine neue Revision an."
    add("other_language", q.format("adalo"), german)
    add(None, q.format("adalo") + " Please answer in German.", german)
    add(None, q.format("adalo"), f"You asked: {q.format('adalo')}\n{a.format('adalo')}")
    add(None, "", "anything goes")
    add(None, None, None)
    return rows, want


def test_each_kind_of_defect(spark):
    rows, want = table()
    df = spark.createDataFrame(rows + rows[:30] + [(None, "q", None, "ok", None, "")], SCHEMA)
    got = P.find_defects(df).collect()
    assert len(got) == len({r["event_id"] for r in got})
    assert {r["event_id"]: r["defect"] for r in got} == want


def test_empty_table_and_long_texts(spark):
    assert P.find_defects(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [("a", "Tell me about rows.", "Rows are kept. " * 20_000, "ok", None, ""), ("b", "x" * 200_000, "x" * 200_000, "ok", None, "")]
    assert {r["event_id"]: r["defect"] for r in P.find_defects(spark.createDataFrame(rows, SCHEMA)).collect()} == {"b": "copied"}


def test_minhash_links_only_near_copies(spark):
    base = "the first word and nine more words that make a rather long clause about nothing at all today"
    texts = [base, base.replace("today", "now"), "something else entirely that has a few words of its own here", "short one"]
    got = {r["clause"]: r["cluster"] for r in P.cluster_templates(spark.createDataFrame([(t,) for t in texts + texts[:1]], "clause string")).collect()}
    assert got[texts[0]] == got[texts[1]] and len(set(got.values())) == 3 and set(got) == set(texts)


def test_chains_of_near_copies_are_one_cluster(spark):
    words = [f"w{i:02d}" for i in range(60)]
    chain = [" ".join(words[i : i + 44]) for i in range(0, 16, 2)]  # neighbours share 0.9, the ends less than 0.5
    got = {r["clause"]: r["cluster"] for r in P.cluster_templates(spark.createDataFrame([(t,) for t in [*chain, "apart"]], "clause string")).collect()}
    assert {got[t] for t in chain} == {chain[0]} and got["apart"] == "apart"


def test_near_copies_are_linked_beside_a_smaller_text_of_their_bucket(spark, monkeypatch):
    def one_bucket(batches):
        for b in batches:
            yield P.pa.record_batch([P.pa.array([1] * b.num_rows, P.pa.int64()), b.column(0)], names=["bucket", "clause"])

    monkeypatch.setattr(P, "_bands", one_bucket)
    long = " ".join(f"w{i:02d}" for i in range(30))
    texts = ["a smaller text of the bucket", long, f"{long} more"]
    got = {r["clause"]: r["cluster"] for r in P.cluster_templates(spark.createDataFrame([(t,) for t in texts], "clause string")).collect()}
    assert got == {texts[0]: texts[0], texts[1]: texts[1], texts[2]: texts[1]}


def test_openings_with_varying_words_share_their_evidence(spark):
    rows, want = table()
    plain = len(rows)
    # Each clause has 11 or 12 words of which one varies, too few to share 0.8 of its shingles; the sentence has 23.
    names = [a + b for a in ("bar", "cel", "dun", "fol", "gim", "hov") for b in ("essa", "ino")]
    for i, name in enumerate(names):
        q, _ = TOPICS[i % len(TOPICS)]
        rows.append((f"v{i}", q.format(NAMES[i % 10]), f"{name} says this whole matter stays shut here for the present, everybody hears more about that once this office receives news from {name[::-1]}.", "ok", None, ""))
    got = {r["event_id"]: r["defect"] for r in P.find_defects(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want | {f"v{i}": "refusal" for i in range(len(rows) - plain)}


@pytest.mark.parametrize(
    ("text", "language"),
    [("Where is the list of the keys that you have?", "en"), ("Wo finde ich die Liste und wie ist sie sortiert?", "de"), ("Où est la liste des clés que vous avez ?", "fr"), ("¿Dónde está la lista de los que no se usan?", "es"), ("在审计页面选择对应的一周", "zh"), ("```\nthe of and to in\n```", None), ("42", None), ("", None)],
)
def test_language(text, language):
    assert P.language_of(text) == language


def test_other_scripts_and_languages():
    assert P.language_of("Это предложение написано по-русски.") == "cyrillic"
    assert P.language_of("これは日本語の文章です。") == "ja"
    assert P.language_of("이것은 한국어 문장입니다.") == "ko"
    assert P.language_of("Dit is het antwoord, maar wij kunnen niet wachten.") == "nl"
    assert P.asks_for("Please answer in Japanese.", "ja") and not P.asks_for("Please answer.", "ja")


def test_minhash_recall_against_all_pairs(spark):
    rng = random.Random(5)
    texts = []
    for n in range(60):
        base = [f"{rng.choice('abcdef')}{rng.randrange(400)}" for _ in range(rng.randrange(12, 30))]
        texts += [" ".join(base)] + [" ".join([*base[k:], *(f"z{n}{k}{i}" for i in range(k))]) for k in (1, 2)]
    near = {(a, b) for a in texts for b in texts if a < b and len(P.shingles(a) & P.shingles(b)) >= 0.8 * len(P.shingles(a) | P.shingles(b))}
    got = {r["clause"]: r["cluster"] for r in P.cluster_templates(spark.createDataFrame([(t,) for t in texts], "clause string")).collect()}
    assert len(near) > 60 and sum(got[a] == got[b] for a, b in near) >= 0.99 * len(near)
    apart = {(a, b) for a in texts for b in texts if got[a] == got[b]} - {(a, b) for x, y in near for a, b in ((x, y), (y, x), (x, x), (y, y))} - {(t, t) for t in texts}
    assert all(len(P.shingles(a) & P.shingles(b)) > 0 for a, b in apart)  # only chains of near-copies


def test_a_masked_word_stands_for_a_word_of_other_prompts(spark):
    texts = ["x me out on this topic", "count me out on this topic", "x me in", "count me in", "count me out on that topic"]
    got = {r["clause"]: r["cluster"] for r in P.cluster_templates(spark.createDataFrame([(t,) for t in texts], "clause string")).collect()}
    assert got[texts[0]] == got[texts[1]] and len(set(got.values())) == 4


def test_evidence_of_templates(spark):
    pooled = [("same", None, 3), ("same", 1, 3), ("same", 2, 3), ("apart", None, 3), *(("apart", w, 1) for w in range(9)), ("once", None, 1), ("once", 1, 1)]
    got = {r["k"]: r["evidence"] for r in P._evidence(spark.createDataFrame(pooled, "k string, word long, n long"), "k").collect()}
    assert got["same"] > P._SOME and got["apart"] < -P._SOME and got["once"] == 0


def test_an_id_column_of_any_name(spark):
    rows, want = table()
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("event_id", "context").withColumnRenamed("user_text", "words").withColumnRenamed("assistant_text", "tail")
    assert {r["context"]: r["defect"] for r in P.find_defects(df, "context", "words", "tail").collect()} == want
