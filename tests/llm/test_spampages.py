import random

from tallyforge.llm import spampages as S

NAMES = "ada bob cleo dan eve finn gus hal ivy jon kim lee max ned oda pam quin ray sue tom".split()
PROSE = (
    "{} asked whether the report could hide old rows, because nobody had read them since {}. "
    "When the price of a seat is unknown, the table shows a blank and {} adds it later. "
    "We saw {} late rows from the north, and most of them belonged to the same batch. "
    "It took longer than planned, yet {} closed the month before the others did. "
    "After the move to version {} the counter of {} goes back to zero at midnight."
)
KEYS = ["cheap token proxy", "best key vault", "free quota tool", "buy price feed"]


def prose(rng, n=2):
    return "\n".join(PROSE.format(*(rng.choice([x.capitalize() for x in NAMES] + ["12", "2024"]) for _ in range(7))) for _ in range(n))


def pages(seed=1):
    rng = random.Random(seed)
    key = lambda: rng.choice(KEYS)
    out = {f"ok{i}": prose(rng, rng.randrange(1, 5)) for i in range(60)}
    out["refs"] = prose(rng, 2) + "\nReferences\n" + "\n".join(f"[{i}] https://{rng.choice(NAMES)}.example/{i}" for i in range(4))
    out["described"] = "\n".join(f"- [{rng.choice(NAMES)}](https://x.example/{i}): this page explains how the table treats a late row, and it was last checked by {rng.choice(NAMES)}." for i in range(6)) + prose(rng, 3)
    out["partly"] = prose(rng, 4) + "\n" + ", ".join(key() for _ in range(12))
    bad = {
        "list": ", ".join(key() for _ in range(80)), "links": "\n".join(f"* [{key()}](https://{rng.choice(NAMES)}.example/{i})" for i in range(25)),
        "tags": "tags: " + " ".join(key().replace(" ", "-") + f"({i})" for i in range(60)), "shop": "\n".join(f"SKU-{i} | {key()} | blue | {i} mm | sold out" for i in range(40)),
        "sentences": " ".join(f"The {key()} is a {key()} and every {key()} beats the {key()}." for _ in range(30)), "mostly": prose(rng, 1) + "\n" + ", ".join(key() for _ in range(120)),
    }
    return out | bad, set(bad)


def test_stuffed_pages_are_found(spark):
    texts, bad = pages()
    rows = [(k, t, 1.0) for k, t in texts.items()] + [("null", None, 1.0), ("empty", "", 1.0), ("blank", " \n\t", 1.0), ("marks", "!!! ???", 1.0), ("list", texts["list"], 1.0)]
    df = spark.createDataFrame(rows, "doc_id string, text string, odd_share double")
    got = [r["doc_id"] for r in S.find_spam(df).collect()]
    assert bad <= set(got) and not set(got) - bad - {"marks"}
    assert got.count("list") == 2


def test_no_prose_and_empty_tables(spark):
    schema = "doc_id string, text string"
    assert S.score_pages(spark.createDataFrame([], schema)).count() == 0
    only = spark.createDataFrame([("a", "x " * 30_000), ("b", None)], schema)
    assert {r["odd_share"] for r in S.score_pages(only).collect()} == {0.0}


def test_classes():
    (codes, width), = S.stretches("The seat of Ann has 12 rows, see https://x.example/a.")
    assert codes == "aNpNvDN,NU" and width == len("TheseatofAnnhas12rows,seehttps://x.example/a.")
    assert S.stretches("") == []
    model = S.model_of({"^^a": 3, "^aN": 3, "aN.": 3})
    assert S.surprisal(model, "aN.") < S.surprisal(model, "UUU")
    assert len(model) == len(S.ALPHABET) ** 3


ABROAD = {
    "ja": "この代理は、まず手元の記録に全ての出来事を書き込みます。接続が戻ると、数百行ずつ収集器へ送られ、元の時刻のままで受け付けられます。同じ行が二度届くこともありますが、二つ目は無視されます。",
    "ko": "프록시는 모든 이벤트를 먼저 로컬 기록에 저장합니다. 연결이 돌아오면 기록을 수백 줄씩 수집기로 보내고, 수집기는 원래 시각 그대로 받아들입니다. 같은 줄이 두 번 도착할 수도 있지만 두 번째는 무시됩니다.",
    "ru": "Прокси сначала записывает каждое событие в местный журнал. Когда связь возвращается, он отправляет журнал частями по нескольку сотен строк, и сборщик принимает их с исходным временем. Некоторые строки могут прийти дважды, но вторая копия не учитывается.",
    "ar": "يكتب الوكيل كل حدث أولا في سجل محلي. عندما يعود الاتصال يرسل السجل على دفعات من مئات الأسطر، ويقبلها المجمع بوقتها الأصلي. قد تصل بعض الأسطر مرتين ولكن النسخة الثانية تهمل دائما.",
    "pl": "Proxy najpierw zapisuje każde zdarzenie w lokalnym dzienniku. Gdy połączenie wraca, wysyła dziennik w paczkach po kilkaset wierszy, a kolektor przyjmuje je z ich pierwotnym czasem. Niektóre wiersze mogą przyjść dwa razy, ale druga kopia nie jest liczona.",
    "hi": "प्रॉक्सी पहले हर घटना को स्थानीय लॉग में लिखता है। जब कनेक्शन वापस आता है तो वह लॉग को कुछ सौ पंक्तियों के समूहों में भेजता है और संग्राहक उन्हें मूल समय के साथ स्वीकार करता है।",
}


def test_prose_of_other_languages_and_scripts_is_no_spam(spark):
    rng = random.Random(2)
    texts = {f"ok{i}": prose(rng, 3) for i in range(60)} | ABROAD
    texts |= {"bad-ar": "رخيص وكيل رمز، " * 40, "bad-ko": "무료 할당 도구, " * 60, "bad-ru": "дешёвый прокси токен, " * 50, "bad-ja": "無料トークン, 格安プロキシ, " * 40}
    got = {r["doc_id"] for r in S.find_spam(spark.createDataFrame(list(texts.items()), "doc_id string, text string")).collect()}
    assert got == {"bad-ar", "bad-ko", "bad-ru", "bad-ja"}


def test_packed_scores_are_those_of_each_stretch(spark):
    texts, _ = pages()
    df = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    counts = {}
    every = {k: S.stretches(t) for k, t in texts.items()}
    for page in every.values():
        for codes, _ in page:
            if S.kind_of(codes) == S._PROSE:
                c = "^^" + codes
                for g in zip(c, c[1:], c[2:]):
                    counts["".join(g)] = counts.get("".join(g), 0) + 1
    model = S.model_of(counts)
    values = [S.surprisal(model, c) for page in every.values() for c, _ in page if S.kind_of(c) == S._PROSE]
    mean = sum(values) / len(values)
    far = 4 * (sum(v * v for v in values) / len(values) - mean * mean) ** 0.5
    for r in S.score_pages(df).collect():
        page = every[r["doc_id"]]
        odd = sum(w for c, w in page if abs(S.surprisal(model, c) - mean) > far * (1 + (S.kind_of(c) == S._PROSE)))
        assert abs(r["odd_share"] - odd / max(1, sum(w for _, w in page))) < 1e-6


def test_kinds_of_many_stretches_are_those_of_each():
    rng = random.Random(3)
    texts, _ = pages()
    codes = [c for t in [*texts.values(), *ABROAD.values(), "وكيل " * 30] for c, _ in S.stretches(t)]
    codes += ["".join(rng.choice(S.ALPHABET) for _ in range(rng.randrange(1, 40))) for _ in range(500)]
    numbers = S._NUMBER[S.np.frombuffer("".join(codes).encode(), S.np.uint8)]
    assert S._kinds(numbers, S.np.array([len(c) for c in codes])).tolist() == [S.kind_of(c) for c in codes]


def test_plain_letters_are_cut_alike_by_both_patterns():
    texts, _ = pages()
    for t in [*texts.values(), "a_b __ c1d www.x.example/a?b=(c) don't 3.5% [x](http://y)"]:
        assert t.isascii() and S._TOKEN.findall(t) == S._ASCII_TOKEN.findall(t)
