"""Pages of repeated keywords, links or tags instead of sentences.

A text becomes a sequence of word classes: groups of function words, content words by
how often they occurred shortly before, numbers, links, punctuation.  A trigram model of
these classes is trained on prose stretches of all documents; a stretch whose perplexity
under it is abnormally high (keywords, links, tags: no function words, or the same content
words over and over) or abnormally low is no prose, and a page is flagged if such
stretches make up more than half of its text.

Japanese and Korean show their grammar in kana and word endings, which count as function words.  Words
of scripts without known function words (Arabic, Hebrew, Indic, Thai and others) have classes of their own;
stretches of them are no prose only if they repeat words, list links or hold hardly any words.

The alphabet of classes is fixed, so the model has at most ``len(ALPHABET) ** 3`` counts
whatever the number of documents; these are summed up over all of them and broadcast.  Texts are read
once; what is kept of them are their classes, compressed by some hundred pages, and then a number a stretch.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallyforge.runtime import checkpoint, spread

# Function words by group (articles, prepositions, conjunctions, pronouns,
# auxiliaries and common verbs, adverbs and negations, quantifiers, question words).
FUNCTION_WORDS = {
    "a": "the a an le la les l un une des el los las o os as der die das den dem ein eine einen einer eines einem lo uma um",
    "p": "of to in for on with at by from about into over after before under between without within during since until up out off against through as "
    "de du d à en dans pour sur avec sans sous entre depuis par vers chez au aux del al con sin sobre desde hasta para por hacia "
    "do da dos das em no na nos nas ao aos pelo pela com sem até von zu im mit auf für bei nach aus seit über unter zwischen ohne am zum zur vom",
    "c": "and or but so because although while if when than that unless whether though yet nor et ou mais si que quand car puisque lorsque comme afin "
    "y e ni pero porque aunque mientras cuando como mas embora enquanto quando und oder aber denn weil obwohl wenn dass ob damit als sobald",
    "o": "it its they them their theirs we us our you your he him his she her i me my this these those there here one which who whom whose "
    "il elle ils elles nous vous se ce cet cette ces cela on son sa ses leur leurs notre votre je y lui eux qui dont "
    "él ella ellos su sus se este esta estos estas eso esa le les nos yo tu quien quienes cual "
    "ele ela eles elas seu sua seus suas isso esse este esta quem qual es er sie ihr ihre ihren wir uns sich dies diese dieser diesem dieses man mir ich wer welche welcher",
    "v": "is are was were be been being am has have had do does did will would can could may might must shall should gets goes est sont était ont a été être avoir peut doit fait "
    "es son era está están ha han fue ser puede debe hay há foi são é está pode deve tem ist sind war waren wird werden hat haben wurde wurden kann können muss müssen soll sei",
    "n": "not no never only just also already still even then now again too very more most less least well often once ago together rather "
    "ne pas plus jamais aussi déjà encore même très bien puis donc alors peu seulement non no más muy también ya todavía solo nunca así aún bien "
    "não mais também já ainda só nunca assim muito depois nicht auch schon noch nur sehr mehr dann jetzt wieder immer so trotzdem bereits ganz",
    "q": "each every all any some both many few much several such other another same half two three first second neither either tout tous toute toutes chaque plusieurs quelques autre aucun "
    "todo todos toda todas cada varios algunos otro otra ningún alguns outro outra nenhum alle jede jeder jedes viele einige beide keine kein andere",
    "w": "what how why where whether comment pourquoi où quel quelle qué cómo dónde por qué onde wie was warum wo wohin",
}
# Function words of further languages (Dutch, Scandinavian, Polish, Czech, Turkish, Romanian, Indonesian,
# Finnish, Hungarian; Russian, Ukrainian, Bulgarian; Greek), by group as far as they have it.
MORE_FUNCTION_WORDS = {
    "a": "het een ett det den en et unei unui niște az egy ο η το οι τα του της των τον την ένα μια ένας",
    "p": "van voor met aan naar bij uit tegen tussen door i på av till från för med om vid mellan under til fra ved efter w na z ze do od przez przy dla nad pod przed między po za "
    "ve na se s k ke u o pro při nad pod před mezi kvůli için ile gibi kadar göre sonra önce la cu pe din pentru prin între sub către untuk dengan dari pada oleh ke di dalam "
    "в на с со к от из по для при о об без до за над под перед между через у від із з про та във със към от като за σε με για από προς χωρίς μετά μέχρι στο στη στην στον στα",
    "c": "maar omdat dat als want dus och att men eller därför eftersom og eller fordi at i oraz ale lub że bo gdy jeśli ponieważ więc žebo ale nebo že protože když aby ve veya ama çünkü ki eğer "
    "și sau dar că dacă pentru dan atau tetapi karena bahwa jika yang ja tai mutta että koska jos és vagy de hogy mert ha и а но или что чтобы потому если когда также і та але або що якщо щоб коли "
    "и но или че ако защото когато και ή αλλά ότι αν γιατί όταν που να",
    "o": "hij zij wij jij hun ons deze dit die zich jag du han hon vi ni de sig denna detta jeg hun hans hendes się ten ta to tego tej tym ich jego jej nas nam on ona oni který která které ten tato toto si jeho její "
    "bu şu o bir onlar biz siz ben sen acesta această care îl lui ei ini itu mereka kami kita anda dia hän se ne tämä ez az ő ők он она оно они мы вы я ты его её их им это этот эта эти который которая которые себя свой "
    "він вона вони ми ви це цей ця який яка які той тя те ние вие това този тази който която които αυτός αυτή αυτό αυτά μας σας τους οποία οποίο",
    "v": "is was zijn worden wordt werd heeft hebben kan kunnen moet är var vara blir blev har hade kan ska måste er være bliver havde skal jest są był była było być ma może można zostać je jsou byl byla bylo být má může "
    "değil var yok olan olarak oldu olur este sunt era fi are poate adalah akan dapat bisa telah sudah on ovat oli olla van volt lesz kell был была было были быть есть может можно будет є був була було бути може "
    "е са беше има може ще είναι ήταν έχει έχουν μπορεί θα",
    "n": "niet ook nog maar al alleen wel inte också redan bara ikke også kun allerede nie też już tylko jeszcze bardzo tak ne také už jen ještě velmi da hem sadece çok daha nu și doar foarte tidak juga hanya sangat ei myös vain nem is csak már "
    "не ни уже только ещё же бы лишь очень также не вже тільки ще дуже и само вече още много δεν μη και μόνο ήδη πολύ",
    "q": "elk alle veel meer andere alla många flera andra alle mange andre każdy wszystkie wiele inne každý všechny mnoho jiné her tüm bazı fiecare toate multe semua setiap beberapa kaikki moni minden sok каждый все всё много другие кожен всі багато "
    "всеки всички много κάθε όλα όλοι πολλά άλλα",
    "w": "wat hoe waarom waar wanneer vad hur varför var när hvad hvordan hvorfor co jak dlaczego gdzie kiedy jak proč kde kdy ne nasıl neden nerede ce cum unde când apa bagaimana mengapa mitä miten miksi mit hogyan miért "
    "как где почему зачем куда як де чому какво как къде защо πώς πού γιατί τι",
}
# Chinese function characters.
FUNCTION_CHARACTERS = "的了在是和也不就都而及与着或这那被把对从到向以为会能可还已经即使但因如果请之后由于所其当将我你他它们没有并且只每又很再才更先按"
# Syllables that end a Korean word as particle or ending.
KOREAN_ENDINGS = "은는이가을를에의로와과도만서다고며면지요게나까니든라"

_MARKED = "\u0300-\u036f\u0591-\u05c7\u0610-\u061a\u064b-\u065f\u0900-\u0963\u0966-\u0dff\u0e00-\u0e7f"  # letters with signs of their own
_LETTER = "[^\\W_㐀-鿿぀-ヿ]"
_TOKEN = re.compile(
    rf"(?:https?://|www\.)[^\s)\]>]+|{_LETTER}+(?:[{_MARKED}]+{_LETTER}*)*|[ぁ-ゟ]+|[゠-ヿ]+|[㐀-鿿]|\n|[^\w\s]"
)
_ASCII_TOKEN = re.compile(r"(?:https?://|www\.)[^\s)\]>]+|[A-Za-z0-9]+|\n|[^\w\s]")
_SENTENCE_END = ".!?。！？।؟"
_MARKS = ",.:;()-|/<>[]*#\"'"
ALPHABET = "apcovnqwzZNMRDU" + _MARKS + "~^xyr"
_NEAR = 100
_OFTEN = 6
_STRETCH = 14
_FUNCTION = "apcovnqwz"
_CHUNK = 400

# Tokens of a fixed class; function words also with a capital.
_KNOWN: dict[str, str] = {m: m for m in _MARKS} | {m: "." for m in _SENTENCE_END} | {"，": ",", "、": ",", "،": ","}
for _words in (MORE_FUNCTION_WORDS, FUNCTION_WORDS):
    for _c, _group in reversed(_words.items()):
        _KNOWN |= {v: _c for w in _group.split() for v in (w, w.capitalize(), w.upper())}
_CHARACTERS = frozenset(FUNCTION_CHARACTERS)
_PLAIN_WORDS = {"N": "x", "M": "y", "R": "r"}


def stretches(text: str) -> list[tuple[str, int]]:
    """(classes, width) of each stretch: a line or sentence, with short neighbours joined to it.

    A content word is N if new, M if it occurred once to five times and R if more often among
    the last hundred content words.  Width counts a Chinese character twice, as it is shown.
    """
    out: list[tuple[str, int]] = []
    recent: list[str] = []
    seen: dict[str, int] = {}
    known = _KNOWN.get
    codes: list[str] = []
    width = 0
    before = ""  # the Chinese character just before, if it is no function character

    def content(word: str) -> str:
        times = seen.get(word, 0)
        seen[word] = times + 1
        recent.append(word)
        if len(recent) > _NEAR:
            seen[recent[-_NEAR - 1]] -= 1
        return "N" if times == 0 else "M" if times < _OFTEN else "R"

    for token in (_ASCII_TOKEN if text.isascii() else _TOKEN).findall(text):
        code = known(token)
        if code is not None:
            width += len(token)
            codes.append(code)
            before = ""
            if code == "." and len(codes) >= _STRETCH:
                out.append(("".join(codes), width))
                codes, width = [], 0
            continue
        first = token[0]
        if token == "\n":
            if len(codes) >= _STRETCH:
                out.append(("".join(codes), width))
                codes, width = [], 0
        elif first > "ɏ" and not "Ḁ" <= first <= "ỿ":
            if "㐀" <= first <= "鿿":
                width += 2
                if token in _CHARACTERS:
                    codes.append("z")
                else:
                    codes.append(content(before + token) if before else "Z")
                    before = token
                    continue
            elif "ぁ" <= first <= "ゟ":
                width += 2 * len(token)
                codes.append("z")
            elif "가" <= first <= "힯":
                width += 2 * len(token)
                codes.append(content(token))
                if len(token) > 1 and token[-1] in KOREAN_ENDINGS:
                    codes.append("z")
            elif "゠" <= first <= "ヿ" or "Ͱ" <= first <= "ӿ":
                width += len(token) * (2 if first >= "゠" else 1)
                codes.append(content(token.lower()))
            elif first.isalpha():
                width += len(token)
                codes.append(_PLAIN_WORDS[content(token)])
            else:
                width += len(token)
                codes.append("D" if first.isalnum() else "~")
        elif token.isalpha():
            width += len(token)
            codes.append(content(token.lower()))
        else:
            width += len(token)
            codes.append("U" if token.startswith(("http", "www")) else "D" if first.isalnum() else "~")
        before = ""
    if codes:
        if out and len(codes) < _STRETCH // 2:
            out[-1] = (out[-1][0] + "".join(codes), out[-1][1] + width)
        else:
            out.append(("".join(codes), width))
    return out


def is_prose(codes: str) -> bool:
    """Whether a stretch may train the model: function words of several groups, few links, few words said again and again."""
    each = [codes.count(c) for c in _FUNCTION]
    function = sum(each)
    words = function + sum(codes.count(c) for c in "ZNMR")
    varied = sum(n > 0 for n in each) >= 3 or each[-1] >= 3
    return words >= 8 * (1 + codes.count("U")) and function >= 0.2 * words and varied and codes.count("R") <= 0.1 * words


_OTHER, _PROSE, _PLAIN, _ODD = 0, 1, 2, 3


def kind_of(codes: str) -> int:
    """Prose, or another stretch that the model judges; without known function words: plain, or odd by its repetitions, links and marks."""
    plain = sum(codes.count(c) for c in "xyr")
    if plain * 2 > len(codes) - codes.count("~") or plain > sum(codes.count(c) for c in _FUNCTION + "ZNMR"):
        odd = codes.count("r") > 0.3 * plain or codes.count("U") * 8 > plain or plain * 2 < len(codes)
        return _ODD if odd else _PLAIN
    return _PROSE if is_prose(codes) else _OTHER


_K = len(ALPHABET)
_NUMBER = np.full(256, 255, np.uint8)
_NUMBER[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(_K)
_START = ALPHABET.index("^")
_PACKED = ("codes", "lengths", "widths", "kinds", "stretches")


def _trigrams(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each class with the two before it in its stretch, stretch of each class)."""
    stretch = np.repeat(np.arange(len(lengths)), lengths)
    padded = np.full(len(codes) + 2 * len(lengths), _START, np.int64)
    at = np.arange(len(codes)) + 2 * (stretch + 1)
    padded[at] = codes
    return (padded[at - 2] * _K + padded[at - 1]) * _K + padded[at], stretch


def _kinds(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``kind_of`` for many stretches at once."""
    n = len(lengths)
    stretch = np.repeat(np.arange(n), lengths)
    counts = np.bincount(stretch * _K + codes, minlength=n * _K).reshape(n, _K)
    of = lambda classes: counts[:, [ALPHABET.index(c) for c in classes]]
    each = of(_FUNCTION)
    function, content, plain = each.sum(axis=1), of("ZNMR").sum(axis=1), of("xyr").sum(axis=1)
    words, links, often = function + content, of("U")[:, 0], of("R")[:, 0]
    varied = ((each > 0).sum(axis=1) >= 3) | (each[:, -1] >= 3)
    prose = (words >= 8 * (1 + links)) & (function >= 0.2 * words) & varied & (often <= 0.1 * words)
    odd = (of("r")[:, 0] > 0.3 * plain) | (links * 8 > plain) | (plain * 2 < lengths)
    unknown = (plain * 2 > lengths - of("~")[:, 0]) | (plain > words)
    return np.where(unknown, np.where(odd, _ODD, _PLAIN), np.where(prose, _PROSE, _OTHER)).astype(np.uint8)


def _pack(a: np.ndarray) -> bytes:
    return zlib.compress(a.tobytes(), 3)


def _unpack(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


def _encode(doc_id: str, kind: pa.DataType):
    """Chunks of pages: ids and packed classes; at the end of a task its counts of classes in prose, as rows without ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(_K**3, np.int64)
        names = ["ids", *_PACKED, "gram", "n"]
        for b in batches:
            for start in range(0, b.num_rows, _CHUNK):
                part = b.slice(start, _CHUNK)
                every = [stretches(t) if t else [] for t in part.column(1).to_pylist()]
                flat = [s for page in every for s in page]
                codes = _NUMBER[np.frombuffer("".join(c for c, _ in flat).encode("ascii"), np.uint8)]
                lengths = np.fromiter((len(c) for c, _ in flat), np.uint32, len(flat))
                kinds = _kinds(codes, lengths.astype(np.int64))
                grams, of = _trigrams(codes, lengths)
                counts += np.bincount(grams[kinds[of] == _PROSE], minlength=_K**3)
                packed = [codes, lengths, np.fromiter((w for _, w in flat), np.uint32, len(flat)), kinds, np.fromiter(map(len, every), np.uint32, len(every))]
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.record_batch([ids, *(pa.array([_pack(a)], pa.binary()) for a in packed), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64())], names=names)
        seen = np.flatnonzero(counts)
        n = len(seen)
        yield pa.record_batch([pa.nulls(n, pa.list_(kind)), *(pa.nulls(n, pa.binary()) for _ in _PACKED), pa.array(seen, pa.int32()), pa.array(counts[seen], pa.int64())], names=names)

    return run


def model_of(counts: dict[str, int], weight: float = 5.0) -> dict[tuple[str, str, str], float]:
    """Surprisal of every class after any two, interpolated with bigrams and single classes."""
    three, two, one = Counter(), Counter(), Counter()
    for g, n in counts.items():
        three[g[:2]] += n
        two[g[1:]] += n
        one[g[2]] += n
    total, after = sum(one.values()), Counter()
    for g, n in two.items():
        after[g[0]] += n
    model = {}
    for z in ALPHABET:
        p1 = (one[z] + 1) / (total + len(ALPHABET))
        for y in ALPHABET:
            p2 = (two[y + z] + weight * p1) / (after[y] + weight)
            for x in ALPHABET:
                model[x, y, z] = -math.log((counts.get(x + y + z, 0) + weight * p2) / (three[x + y] + weight))
    return model


def surprisal(model: dict[tuple[str, str, str], float], codes: str) -> float:
    """Mean surprisal of a stretch: the logarithm of its perplexity."""
    c = "^^" + codes
    return sum(map(model.__getitem__, zip(c, c[1:], c[2:], strict=False))) / max(1, len(codes))


def _text_of(gram: int) -> str:
    return ALPHABET[gram // _K // _K] + ALPHABET[gram // _K % _K] + ALPHABET[gram % _K]


def score_pages(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", deviations: float = 4.0) -> DataFrame:
    """(doc_id, odd_share): the share of each text in stretches of abnormal perplexity.

    Abnormal is more than ``deviations`` standard deviations from the mean of all prose
    stretches, twice as many for stretches shaped like prose, which may be of a rarer language.  NULL, empty and blank texts have a share of 0; texts of any length are read
    whole.  Without any prose among the documents there is nothing to compare with, and all
    shares are 0.  Rows that repeat are scored each.
    """
    kind = documents.schema[doc_id].dataType.simpleString()
    pages = spread(documents.select(doc_id, text))
    arrow = to_arrow_type(documents.schema[doc_id].dataType)
    packed = ", ".join(f"{n} binary" for n in _PACKED)
    encoded = checkpoint(pages.mapInArrow(_encode(doc_id, arrow), f"ids array<{kind}>, {packed}, gram int, n long"))
    # At most len(ALPHABET) ** 3 rows, a fixed number.
    counts = encoded.filter("gram is not null").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    model = model_of({_text_of(r["gram"]): r["n"] for r in counts})
    values = np.array([model[x, y, z] for x in ALPHABET for y in ALPHABET for z in ALPHABET], np.float64)
    shared = documents.sparkSession.sparkContext.broadcast(values)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks of pages with the perplexity of each stretch as a logarithm, and the sums over their prose."""
        for b in batches:
            out = []
            for row in b.select(list(_PACKED)).to_pylist():
                lengths, kinds = _unpack(row["lengths"], np.uint32), _unpack(row["kinds"], np.uint8)
                grams, of = _trigrams(_unpack(row["codes"], np.uint8), lengths)
                mean = np.bincount(of, shared.value[grams], len(lengths)) / np.maximum(lengths, 1)
                prose = mean[kinds == _PROSE]
                out.append((_pack(mean.astype(np.float32)), row["widths"], row["kinds"], row["stretches"], len(prose), float(prose.sum()), float((prose**2).sum())))
            kinds_ = (pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.float64(), pa.float64())
            yield pa.record_batch([b.column("ids"), *(pa.array([o[i] for o in out], t) for i, t in enumerate(kinds_))], names=["ids", "means", "widths", "kinds", "stretches", "n", "s", "ss"])

    scored = encoded.filter("ids is not null").mapInArrow(score, f"ids array<{kind}>, means binary, widths binary, kinds binary, stretches binary, n long, s double, ss double")
    scored = checkpoint(scored)
    n, total, squares = scored.agg(F.sum("n"), F.sum("s"), F.sum("ss")).first()
    mean = total / n if n else 0.0
    far = deviations * math.sqrt(max(0.0, squares / n - mean * mean)) if n else math.inf

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, row in enumerate(b.select(["means", "widths", "kinds", "stretches"]).to_pylist()):
                kinds, widths, per_page = _unpack(row["kinds"], np.uint8), _unpack(row["widths"], np.uint32), _unpack(row["stretches"], np.uint32)
                limit = np.where(kinds == _PROSE, 2 * far, far)
                odd = np.where(kinds >= _PLAIN, kinds == _ODD, np.abs(_unpack(row["means"], np.float32) - mean) > limit)
                page = np.repeat(np.arange(len(per_page)), per_page)
                whole, bad = np.bincount(page, widths, len(per_page)), np.bincount(page, widths * odd, len(per_page))
                yield pa.record_batch([b.column("ids")[i].values, pa.array(bad / np.maximum(whole, 1), pa.float64())], names=[doc_id, "odd_share"])

    return scored.select("ids", "means", "widths", "kinds", "stretches").mapInArrow(judge, f"`{doc_id}` {kind}, odd_share double")


def find_spam(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", deviations: float = 4.0) -> DataFrame:
    """(doc_id) of the documents more than half of whose text is of abnormal perplexity."""
    return score_pages(documents, doc_id, text, deviations).filter("odd_share > 0.5").select(doc_id)
