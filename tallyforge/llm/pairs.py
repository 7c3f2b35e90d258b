"""Defects of question-answer pairs: empty, truncated, refusal, copied, other_language.

Refusals are found by their templates alone, not by any list of phrases.  An answer gives
its opening (the first sentences, as one text), the clauses of the opening and the clauses after
it; words of the question and numbers are masked, and these templates are clustered by MinHash over
five-word shingles, each membership verified at a Jaccard similarity of 0.8.  How many words the
prompts of a cluster share adds up to evidence that it belongs to a topic or recurs under
unrelated prompts.  A cluster of the second kind that mostly stands in answers without a clause of any topic is a
refusal's; one that is mostly followed by such a clause is a preface.  An answer with a
refusal's template in its opening and without a clause of a topic only declines.

Whether a text without a full stop was cut is read from the corpus, too: the last words
either end sentences elsewhere or always go on.  Copies and languages are judged row by row.
The texts are read once: one pass in Python gives each pair's facts and templates and the
counts of word contexts; everything after it runs on numbers.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.conversations import is_blank
from tallyforge.llm.spampages import FUNCTION_CHARACTERS, FUNCTION_WORDS
from tallyforge.runtime import checkpoint, spread

# What stands for no value, as letters and digits only.
STAND_INS = frozenset(
    "none null nil na nan undefined empty noanswer nocontent noresponse emptyresponse emptyanswer noreply nodata blank novalue notavailable "
    "keine keineantwort leer k0a aucun aucune vide sansréponse ninguno ninguna vacío sinrespuesta 无 空 暂无 没有 无内容 无回答 空白".split()
)
# Words that tell languages apart.
LANGUAGE_WORDS = {
    "en": "the of and to is that it for with are was this from which have not you your when can how what does why by then at before who all is a in on or",
    "de": "was der die das und ist nicht ein eine von den dem mit sich auf für wie ich sie wird zu bei nach aus auch warum oder im am hat kann wenn sind einem einen des zum",
    "fr": "le la les des et est une un du que qui dans pour pas sur avec ce cette au aux comment pourquoi vous je ne se sont il elle mon par plus n'est d'un quand mois",
    "es": "cuál si lo el la los las y es una un del que en para por con no se su cómo qué más como lo al este esta cuando dónde por qué puedo hay sin este cada tiene",
    "pt": "o os as e é uma um do da dos das que em para por com não se seu sua mais ao quando uns pelo pela como isso você há são está",
    "it": "il lo gli e è una un di del della che in per con non si come più al quando perché sono questo questa nel alla",
}
# Words of further languages; those that one of the languages above has, too, are left out.
MORE_LANGUAGE_WORDS = {
    "nl": "het een van niet zijn voor met aan ook naar wordt maar kunnen deze wij jij heeft werd hoe waarom uw dat door wat over worden",
    "pl": "nie się jest że jak na dla przez oraz który ale czy są może jego tego także gdy ten ta od po jej lub",
    "sv": "och att det som är för inte på ett jag kan vad hur till av har om också men eller från blir",
    "tr": "bir ve bu için değil ile olarak daha çok gibi ne nasıl neden olan ama var bunu şu kadar sonra",
}
# Names of languages in these languages.
LANGUAGE_NAMES = {
    "en": "english englisch englische englischen anglais anglaise inglés ingles inglês inglese 英文 英语 英語",
    "de": "german deutsch deutsche deutschen deutscher allemand allemande alemán aleman alemão tedesco 德文 德语 德語",
    "fr": "french französisch französische französischen français francais francés frances francês francese 法文 法语 法語",
    "es": "spanish spanisch spanische spanischen espagnol espagnole español espanol castellano espanhol spagnolo 西班牙文 西班牙语 西班牙語",
    "zh": "chinese mandarin chinesisch chinesische chinesischen chinois chinoise chino chinês cinese 中文 汉语 漢語 普通话",
    "pt": "portuguese portugiesisch portugais portugués português portoghese 葡萄牙文 葡萄牙语",
    "it": "italian italienisch italien italiano 意大利文 意大利语",
    "nl": "dutch niederländisch néerlandais holandés 荷兰语", "pl": "polish polnisch polonais polaco 波兰语",
    "sv": "swedish schwedisch suédois sueco 瑞典语", "tr": "turkish türkisch turc turco 土耳其语",
    "ja": "japanese japanisch japonais japonés 日文 日语", "ko": "korean koreanisch coréen coreano 韩文 韩语",
    "cyrillic": "russian russisch russe ruso ukrainian bulgarian 俄文 俄语", "arabic": "arabic arabisch arabe árabe 阿拉伯语",
    "greek": "greek griechisch grec griego 希腊语", "hebrew": "hebrew hebräisch hébreu hebreo 希伯来语",
    "devanagari": "hindi 印地语", "thai": "thai thailändisch thaï tailandés 泰语",
}
# Scripts that stand for a language of their own here.
SCRIPTS = {"ja": "぀-ヿ", "ko": "가-힯ᄀ-ᇿ", "cyrillic": "Ѐ-ӿ", "arabic": "؀-ۿ", "greek": "Ͱ-Ͽ", "hebrew": "֐-׿", "devanagari": "ऀ-ॿ", "thai": "฀-๿"}

_FUNCTION = frozenset(w for group in FUNCTION_WORDS.values() for w in group.split())
_BY_LANGUAGE = {lang: frozenset(ws.split()) for lang, ws in LANGUAGE_WORDS.items()}
_FIRST = frozenset().union(*_BY_LANGUAGE.values())
# What a word says for each language: a word of several languages says less.
_SAYS: dict[str, list[tuple[str, float]]] = {
    w: [(lang, 1 / sum(w in k for k in _BY_LANGUAGE.values()) ** 2) for lang, known in _BY_LANGUAGE.items() if w in known] for w in _FIRST
} | {w: [(lang, 1.0)] for lang, ws in MORE_LANGUAGE_WORDS.items() for w in ws.split() if w not in _FIRST}
_SCRIPT = {lang: re.compile(f"[{chars}]") for lang, chars in SCRIPTS.items()}
_ANY_SCRIPT = re.compile(f"[{''.join(SCRIPTS.values())}]")
_NAMES = {name: lang for lang, names in LANGUAGE_NAMES.items() for name in names.split()}
_CJK = re.compile(r"[㐀-鿿]")
_CJK_NAMES = [(n, lang) for n, lang in _NAMES.items() if _CJK.search(n)]
_END = ".!?。！？"
_BREAK = frozenset((*_END, "\n", *";；:：,，"))
_PIECE = re.compile(r"[㐀-鿿]|[^\W\d_㐀-鿿]+(?:['’][^\W\d_㐀-鿿]+)*|\d+(?:[.,:]\d+)*|[.!?。！？\n;；:：,，]")
_MARKS = re.compile(r"(?:^| )[;；:：,，](?= |$)")
_ENDS = re.compile(r"(?:^| )[.!?。！？\n](?= |$)")
_DIGITS = frozenset("0123456789")
_CONNECTIVES = frozenset("but however and aber doch mais cependant pero sin embargo 但 但是 et y und".split())
_CODE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`", re.DOTALL)
_MARKUP = re.compile(r"</?[a-zA-Z][^<>]*/?>")
_BLANK = re.compile(r"[\W_]+")
_LEAD = re.compile(r"[^:：\n]{1,60}[:：\n]")
_OPENING = 13
_LEAST_LINKED = 8  # two different texts under so many words (4 shingles) cannot share 0.8 of their shingles
_ID = "__pair"
_LEAST_PLAIN = 4  # words that are not masked, for templates that differ in a masked word
# Share of its topic words that a prompt has in common with another one on average: of one topic, and of any.
_OF_TOPIC, _OF_ALL = 0.35, 0.07
# Evidence is the logarithm of the likelihood ratio of these; it counts from two prompts of a template on, up to a limit.
_SOME, _LIMIT = 0.9, 5.0


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _letters(text: str) -> str:
    """Letters and digits without case, width and anything between them."""
    return _BLANK.sub("", (text if text.isascii() else unicodedata.normalize("NFKC", text)).casefold())


def _grams(s: str) -> set[str]:
    n = 2 if not s.isascii() and len(_CJK.findall(s)) * 2 > len(s) else 3
    return {s[i : i + n] for i in range(len(s) - n + 1)} or ({s} if s else set())


def is_empty(answer: str | None) -> bool:
    """Nothing but blanks, invisible characters, punctuation and markup, or a stand-in for no value."""
    return answer is None or _says_nothing(_letters(_MARKUP.sub("", answer) if "<" in answer else answer))


def _says_nothing(letters: str) -> bool:
    return letters in STAND_INS or not any(c.isalnum() for c in letters)


def is_copy(question: str, answer: str) -> bool:
    """The answer says the question again and nothing else, by shared letter sequences in both directions."""
    return _copies(_letters(question), _letters(answer), answer)


def _copies(question: str, letters: str, answer: str) -> bool:
    q = _grams(question)
    if not letters:
        return False
    # Most answers lack too much of the question, which is told without taking them apart.
    spare = 0.25 * len(q)
    for g in q:
        if g not in letters:
            spare -= 1
            if spare < 0:
                return False
    lead = _LEAD.match(answer)
    for s, least in ((letters, 0.65), (_letters(answer[lead.end() :]) if lead else "", 0.85)):
        g = _grams(s)
        shared = len(q & g)
        # Words of one's own may be few in number, too, however long the question is.
        if g and shared >= least * len(g) and shared >= 0.75 * len(q):
            return True
    return False


def _language(words: list[str], text: str) -> str | None:
    """The language of a text's pieces in lower case, or None if too little speaks for one."""
    scores: dict[str, float] = defaultdict(float)
    for w in words:
        if w in _SAYS:
            for lang, weight in _SAYS[w]:
                scores[lang] += weight
    if "'" in text or "’" in text:
        for w in words:
            if len(w) > 2 and (w[1] in "'’" and w[0] in "ldnscj" or w[2] in "'’" and w[:2] == "qu"):
                scores["fr"] += 1
    plain = text.isascii()
    if not plain:
        han = len(_CJK.findall(text))
        if _ANY_SCRIPT.search(text):
            seen = {lang: len(p.findall(text)) for lang, p in _SCRIPT.items()}
            if han and seen["ja"]:
                seen["ja"] += han
            most = max(seen, key=seen.__getitem__)
            if seen[most] >= 4 and seen[most] * 2 >= sum(c.isalpha() for c in text):
                return most
        if han >= 4 and han >= sum(w[0].isalpha() for w in words) - han:
            return "zh"
        for lang, chars in (("de", "äöüß"), ("es", "ñ¿¡"), ("fr", "çêèœ"), ("pt", "ãõ"), ("pl", "ąęłśżźć"), ("tr", "ğşı")):
            scores[lang] += sum(c in text for c in chars)
    if not scores:
        return None
    best = max(scores, key=scores.__getitem__)
    most = scores[best]
    if most < 1 or any(1.4 * s > most for lang, s in scores.items() if lang != best):
        return None
    return best if most >= 0.05 * len(words) or most >= 0.05 * sum(w[0].isalpha() for w in words) else None


def language_of(text: str) -> str | None:
    """The language of a text outside code, or None if too little speaks for one."""
    text = _CODE.sub(" ", text) if "`" in text else text
    return _language(_PIECE.findall(text.lower()), text)


def asks_for(question: str, language: str) -> bool:
    """Whether a question names the language it wants."""
    low = question.lower()
    words = set(re.findall(r"[^\W\d_]+", low))
    return any(_NAMES.get(w) == language for w in words) or any(lang == language and n in low for n, lang in _CJK_NAMES)


def _clauses(line: str) -> list[str]:
    out = []
    for clause in _MARKS.split(line):
        tokens = clause.split()
        start = 0
        while start < len(tokens) and tokens[start] in _CONNECTIVES:
            start += 1
        if start < len(tokens):
            out.append(" ".join(tokens[start:]))
    return out


def _read(told: set[str], pieces: list[str]) -> tuple[list[list[str]], bool, list[str], list[str]]:
    """(lines of masked tokens, whether the last one ended, templates of the opening, clauses after it).

    Numbers become 0, the told words x.  The opening is the first sentences as one text, up to the one that
    completes 13 words: from then on (9 shingles) texts of which an outer word differs share 0.8 of their shingles.
    """
    masked = " ".join([t if t not in told and t[0] not in _DIGITS else "x" if t in told else "0" for t in pieces])
    parts = _ENDS.split(masked)
    ended = not parts[-1].strip(" ;；:：,，")
    lines: list[list[str]] = []
    opened: list[str] = []
    later: list[str] = []
    opening: list[str] = []
    for part in parts:
        line = _MARKS.sub(" ", part).split()
        if not line:
            continue
        lines.append(line)
        (opened if len(opening) < _OPENING else later).extend(_clauses(part))
        if len(opening) < _OPENING:
            opening += line
    if opening:
        opened.append(" ".join(opening))
    return lines, ended, list(dict.fromkeys(opened)), list(dict.fromkeys(later))


def _told(words: list[str]) -> set[str]:
    return {w for w in words if len(w) > 1 and w[0] not in _DIGITS} - _FUNCTION


def templates(question: str, answer: str) -> set[str]:
    """The distinct templates of an answer: its opening and its clauses."""
    _, _, opened, later = _read(_told(_PIECE.findall(question.lower())), _PIECE.findall(answer.lower()))
    return {*opened, *later}


def topic_words(words: list[str]) -> list[str]:
    """What questions may have in common: words, and pairs of Chinese characters, that are no function words."""
    out = []
    before = ""
    for w in words:
        if "㐀" <= w[0] <= "鿿":
            if before and before not in FUNCTION_CHARACTERS and w not in FUNCTION_CHARACTERS:
                out.append(before + w)
            before = w
            continue
        before = ""
        if w not in _BREAK and not w[0].isdigit() and w not in _FUNCTION:
            out.append(w)
    return list(dict.fromkeys(out))


def cut_by_form(answer: str) -> bool:
    """Whether code, brackets, quotes or a table row are left open, or the text ends in the middle of a clause."""
    s = answer.rstrip()
    outside = s
    if "`" in s:
        if s.count("```") % 2:
            return True
        outside = _CODE.sub(" ", s)
    for a, b in ("()", "[]", "{}", "“”", "「」", "（）"):
        if a in outside and outside.rfind(a) > outside.rfind(b):
            return True
    if "|" in outside:
        lines = outside.rstrip().split("\n")
        if len(lines) > 1 and lines[-1].lstrip().startswith("|") and any(set(x.strip()) <= set("|-: ") and "-" in x for x in lines[:-1]):
            head = next(x for x in lines if x.lstrip().startswith("|"))
            if lines[-1].count("|") < head.count("|"):
                return True
    last = s[s.rfind("\n") + 1 :]
    return bool(re.match(r"\s*(?:[-*+]|\d+[.)])\s*$", last)) or s.endswith(("...", "…", ",", "，", ":", "：", "、", ";", "；", "-", "–", "—"))


# Contexts are three tokens, as one number each.
_A, _B, _C = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
_U64 = (1 << 64) - 1


class _Numbers(dict):
    """Token to number; emptied now and then, as numbers depend on the token alone."""

    def __missing__(self, token: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        n = self[token] = xxhash.xxh64_intdigest(token)
        return n


def _context(tokens: list[str], numbers: _Numbers) -> int:
    a, b, c = ([0, 0, 0] + [numbers[t] for t in tokens])[-3:]
    n = (a * _A + b * _B + c * _C) & _U64
    return n - (1 << 64) if n >> 63 else n


_KINDS = [
    ("empty", pa.bool_()), ("copied", pa.bool_()), ("open", pa.bool_()), ("cut", pa.bool_()), ("loose", pa.bool_()), ("lone", pa.bool_()), ("tail", pa.int64()),
    ("stem", pa.int64()), ("foreign", pa.bool_()), ("opened", pa.list_(pa.string())), ("later", pa.list_(pa.string())), ("words", pa.list_(pa.int64())),
]
_COUNTS = [("context", pa.int64()), ("goes", pa.int64()), ("ends", pa.int64()), ("bare", pa.int64())]
_SQL = {pa.bool_(): "boolean", pa.int64(): "long", pa.list_(pa.string()): "array<string>", pa.list_(pa.int64()): "array<long>"}
_FACTS = ", ".join(f"{n} {_SQL[t]}" for n, t in _KINDS + _COUNTS)


def _row(question: str, answer: str | None, numbers: _Numbers) -> tuple[dict, list[list[str]], bool]:
    """A pair's facts, and the lines of its answer for the contexts."""
    out = dict.fromkeys((n for n, _ in _KINDS), None) | {"empty": False, "copied": False, "open": False, "cut": False, "foreign": False}
    letters = "" if answer is None else _letters(_MARKUP.sub("", answer) if "<" in answer else answer)
    if _says_nothing(letters):
        return out | {"empty": True}, [], True
    asked, said = _PIECE.findall(question.lower()), _PIECE.findall(answer.lower())
    lines, ended, opened, later = _read(_told(asked), said)
    out["copied"] = _copies(_letters(question), _letters(answer) if "<" in answer else letters, answer)
    if out["copied"]:
        return out, lines, ended
    out["cut"] = cut_by_form(answer)
    s = (_MARKUP.sub("", answer) if "<" in answer else answer).rstrip(" \t\r\n\"'”’»*_>")
    if not out["cut"] and s and s[-1] not in _END and not answer.rstrip().endswith(("```", "`", "|", "}",
        "]")) and lines and not (ended and not answer.endswith("\n")):
        tokens = lines[-1]
        out |= {
            "open": True, "tail": _context(tokens[-3:], numbers), "stem": _context(tokens[-4:-1], numbers) if len(tokens) > 1 else None,
            "lone": len(tokens) == 1, "loose": tokens[-1] in _FUNCTION or tokens[-1] in FUNCTION_CHARACTERS,
        }
    if "`" in answer:
        language = language_of(answer)
    else:
        language = _language(said, answer)
    if language:
        wants = language_of(question) if "`" in question else _language(asked, question)
        out["foreign"] = bool(wants and wants != language and not asks_for(question, language))
    out |= {"opened": opened, "later": later, "words": [_hash(w) for w in topic_words(asked)]}
    return out, lines, ended


def _context_counts(batch: list[tuple[list[list[str]], bool]], numbers: _Numbers) -> tuple[np.ndarray, np.ndarray]:
    """Distinct contexts of a batch and, per row, how often a token follows, a sentence or line ends, the answer ends bare."""
    tokens: list[int] = []
    place: list[int] = []
    follows: list[int] = []
    for lines, ended in batch:
        for k, line in enumerate(lines):
            n = len(line)
            tokens += [numbers[t] for t in line]
            place += range(n)
            follows += [0] * (n - 1) + [1 if ended or k < len(lines) - 1 else 2]
    t, at = np.array(tokens, np.uint64), np.array(place)
    back = lambda k: np.where(at >= k, np.concatenate([np.zeros(min(k, len(t)), np.uint64), t[: max(0, len(t) - k)]]), np.uint64(0))
    with np.errstate(over="ignore"):
        whole = back(2) * np.uint64(_A) + back(1) * np.uint64(_B) + t * np.uint64(_C)
    found, where = np.unique(whole, return_inverse=True)
    f = np.array(follows)
    return found.view(np.int64), np.column_stack([np.bincount(where[f == k], minlength=len(found)) for k in range(3)]) if len(found) else np.zeros((0, 3), int)


def _facts(pair_id: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers()
        names = [pair_id, *(n for n, _ in _KINDS + _COUNTS)]
        for b in batches:
            read = [_row(q, a, numbers) for q, a in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            facts = [pa.array([r[n] for r, _, _ in read], t) for n, t in _KINDS]
            yield pa.record_batch([b.column(0), *facts, *(pa.nulls(len(read), t) for _, t in _COUNTS)], names=names)
            # The counts of a batch follow as rows without an id.
            found, counts = _context_counts([(lines, ended) for _, lines, ended in read], numbers)
            n = len(found)
            yield pa.record_batch(
                [pa.nulls(n, b.schema.field(0).type), *(pa.nulls(n, t) for _, t in _KINDS), pa.array(found, pa.int64()), *(pa.array(counts[:, k],
                    pa.int64()) for k in range(3))], names=names
            )

    return run


_BANDS, _ROWS = 20, 5  # two texts of similarity 0.8 meet in some band with a probability of 0.9996


def shingles(template: str) -> set[str]:
    """Five-word shingles; a shorter text is one shingle."""
    w = template.split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rng = np.random.default_rng(17)
    mul = rng.integers(1, 1 << 61, _BANDS * _ROWS, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(0, 1 << 61, _BANDS * _ROWS, dtype=np.uint64)
    for b in batches:
        keys, names = [], []
        for t in b.column(0).to_pylist():
            h = np.array([xxhash.xxh64_intdigest(s) for s in shingles(t)], dtype=np.uint64)
            low = ((h[:, None] * mul + add) >> np.uint64(16)).min(axis=0).reshape(_BANDS, _ROWS)
            keys += [_hash(f"{i}:{row.tobytes().hex()}") for i, row in enumerate(low)]
            names += [t] * _BANDS
        yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(names, pa.string())], names=["bucket", "clause"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            s, t = shingles(x), shingles(y)
            keep.append(len(s & t) >= 0.8 * len(s | t))
        yield b.filter(pa.array(keep, pa.bool_()))


def _components(links: DataFrame) -> DataFrame:
    """(clause, cluster): the smallest clause of each connected component of the links.

    Each round takes the smallest label among the neighbours, then that label's own; it ends when no label changes.
    """
    edges = checkpoint(links.select("clause", "cluster").union(links.select("cluster", "clause")).toDF("clause", "other").distinct())
    labels = checkpoint(edges.groupBy("clause").agg(F.least("clause", F.min("other")).alias("cluster")))
    while True:
        near = edges.join(labels.select(F.col("clause").alias("other"), F.col("cluster").alias("seen")), "other")
        near = near.groupBy("clause").agg(F.min("seen").alias("seen"))
        low = labels.join(near, "clause").select("clause", F.col("cluster").alias("old"), F.least("cluster", "seen").alias("cluster"))
        onward = labels.select(F.col("clause").alias("cluster"), F.col("cluster").alias("root"))
        step = checkpoint(low.join(onward, "cluster").select("clause", "old", F.least("cluster", "root").alias("cluster")))
        labels = step.select("clause", "cluster")
        if step.filter("cluster <> old").isEmpty():
            return labels


_RADIX = 0x5851F42D4C957F2D


def _with_a_word_masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each template as a number, and the numbers it would have with any one word masked: linear in its words."""
    numbers = _Numbers()
    signed = lambda n: n - (1 << 64) if n >> 63 else n
    for b in batches:
        of, keys, own = [], [], []
        for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            tokens = t.split()
            plain = sum(w != "x" for w in tokens)
            if plain < _LEAST_PLAIN:
                continue
            power, powers, whole = 1, [], 0
            for w in tokens:
                whole = (whole + numbers[w] * power) & _U64
                powers.append(power)
                power = power * _RADIX & _U64
            found = [signed((whole + (numbers["x"] - numbers[w]) * p) & _U64) for w, p in zip(tokens, powers,
                strict=True) if w != "x"] if plain > _LEAST_PLAIN else []
            if len(tokens) > plain:
                found.append(signed(whole))
                own += [False] * (len(found) - 1) + [True]
            else:
                own += [False] * len(found)
            keys += found
            of += [name] * len(found)
        yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(of, pa.int64()), pa.array(own, pa.bool_())], names=["key", "of", "own"])


def _masked_links(templates: DataFrame) -> DataFrame:
    """Links of templates that are equal once one word of the first is masked, as where only some prompts contain the word."""
    names = templates.select(F.xxhash64("clause").alias("of"), "clause")
    forms = checkpoint(names.mapInArrow(_with_a_word_masked, "key long, of long, own boolean"))
    linked = forms.filter("not own").join(forms.filter("own").select("key", F.col("of").alias("center")), "key").select("of", "center")
    return linked.join(names, "of").select("clause", "center").join(names.select(F.col("of").alias("center"), F.col("clause").alias("cluster")),
        "center").select("clause", "cluster")


def cluster_templates(templates: DataFrame) -> DataFrame:
    """(clause, cluster): each distinct template with the smallest template of its family of verified near-copies.

    A bucket links its members to its smallest one, which costs one row per member; members that
    are no near-copies of the smallest are compared with all others of the bucket, so that no link of
    two templates that share a bucket is lost.  Templates that differ in one masked word are linked, too.
    Links are followed to their end.
    """
    every = templates.select("clause").distinct()
    long = F.size(F.split("clause", " ")) >= _LEAST_LINKED
    in_bucket = checkpoint(every.filter(long).mapInArrow(_bands, "bucket long, clause string").distinct())
    smallest = in_bucket.groupBy("bucket").agg(F.min("clause").alias("cluster"))
    tries = in_bucket.join(smallest, "bucket").filter("clause <> cluster").select("bucket", "clause", "cluster")
    links = checkpoint(tries.select("clause", "cluster").distinct().mapInArrow(_verified, "clause string, cluster string"))
    apart = checkpoint(tries.join(links, ["clause", "cluster"], "left_anti"))
    others = in_bucket.select("bucket", F.col("clause").alias("other"))
    rest = apart.join(others, "bucket").filter("other <> clause and other <> cluster")
    rest = rest.select(F.greatest("clause", "other").alias("clause"), F.least("clause", "other").alias("cluster")).distinct()
    links = links.unionByName(rest.mapInArrow(_verified, "clause string, cluster string")).unionByName(_masked_links(every))
    return every.join(_components(links), "clause", "left").select("clause", F.coalesce("cluster", "clause").alias("cluster"))


def _evidence(pooled: DataFrame, key: str) -> DataFrame:
    """(key, evidence) from (key, word, n): positive for one topic, negative for unrelated prompts, 0 for a single prompt.

    Word NULL counts all prompts.  Two of the n prompts share sum(n_w (n_w - 1)) / (n (n - 1)) words on
    average, of sum(n_w) / n that each has; the shared number is taken as Poisson, each prompt but one as a trial.
    """
    of_word = F.col("word").isNotNull()
    n = F.max(F.when(~of_word, F.col("n"))).cast("double")
    sums = pooled.groupBy(key).agg(n.alias("n"), F.sum(F.when(of_word, F.col("n"))).alias("said"), F.sum(F.when(of_word,
        F.col("n") * (F.col("n") - 1.0))).alias("twice"))
    said, twice = (F.coalesce(c, F.lit(0)) for c in ("said", "twice"))
    evidence = twice / F.col("n") * math.log(_OF_TOPIC / _OF_ALL) - (F.col("n") - 1) * said / F.col("n") * (_OF_TOPIC - _OF_ALL)
    return sums.select(key, F.greatest(F.lit(-_LIMIT), F.least(F.lit(_LIMIT), evidence)).alias("evidence"))


def clause_kinds(rows: DataFrame) -> DataFrame:
    """(template as hash, family, evidence) of the template families with evidence either way."""
    said = rows.select("words", F.explode(F.array_distinct(F.concat("opened", "later"))).alias("clause"))
    counts = said.select(F.xxhash64("clause").alias("template"), F.explode(F.concat("words", F.array(F.lit(None).cast("long")))).alias("word"))
    counts = checkpoint(counts.groupBy("template", "word").agg(F.count(F.lit(1)).alias("n")))
    families = cluster_templates(said)
    families = checkpoint(families.select(F.xxhash64("clause").alias("template"), F.xxhash64("cluster").alias("family")))
    pooled = counts.join(families, "template").groupBy("family", "word").agg(F.sum("n").alias("n"))
    kinds = _evidence(pooled, "family").filter(F.abs("evidence") >= _SOME)
    return families.join(kinds, "family").select("template", "family", "evidence")


def refusals(rows: DataFrame, pair_id: str) -> DataFrame:
    """(pair_id) of the answers that only decline, from the facts of all pairs."""
    rows = rows.filter("opened is not null")
    kinds = checkpoint(clause_kinds(rows))
    each = F.explode(F.concat(F.transform("opened", lambda c: F.struct(c.alias("c"), F.lit(True).alias("first"))), F.transform("later",
        lambda c: F.struct(c.alias("c"), F.lit(False).alias("first")))))
    said = rows.select(pair_id, each.alias("s")).select(pair_id, F.xxhash64("s.c").alias("template"), "s.first").join(kinds, "template")
    # A topic counts as said if its evidence is no weaker than that of the clauses that fit everything.
    topical = F.max("evidence") >= -F.min("evidence")
    per = said.groupBy(pair_id).agg(topical.alias("topical"), F.collect_set(F.when(F.col("first") & (F.col("evidence") < 0), F.col("family"))).alias("families"))
    per = checkpoint(per.filter(F.size("families") > 0))
    # A preface is mostly followed by a clause of a topic, a refusal is not.
    alone = per.select(F.explode("families").alias("family"), F.when(F.col("topical"), 0).otherwise(1).alias("alone"))
    declining = alone.groupBy("family").agg(F.avg("alone").alias("alone")).filter("alone > 0.5").select("family")
    only = per.filter("not topical").select(pair_id, F.explode("families").alias("family"))
    return only.join(declining, "family", "left_semi").select(pair_id).distinct()


def find_defects(df: DataFrame, pair_id: str = "event_id", question: str = "user_text", answer: str = "assistant_text") -> DataFrame:
    """(pair_id, defect): each defective pair with its kind, at most one.

    Of rows with the same id one is taken (the smallest texts); a NULL id and a blank
    question make no pair.  Texts of any length are read whole.  Order of precedence: empty,
    copied, truncated, refusal, other_language.  An empty table gives no rows.
    """
    pairs = df.filter(F.col(pair_id).isNotNull() & ~is_blank(F.col(question)))
    pairs = pairs.groupBy(pair_id).agg(F.min(F.struct(F.col(question).alias("q"), F.col(answer).alias("a"))).alias("p")).select(F.col(pair_id).alias(_ID), "p.q",
        "p.a")
    kind = pairs.schema[_ID].dataType.simpleString()
    facts = checkpoint(pairs.mapInArrow(_facts(_ID), f"`{_ID}` {kind}, {_FACTS}"))
    rows = facts.filter(F.col(_ID).isNotNull())

    open_ = rows.filter("open").select(_ID, "tail", "stem", "loose", "lone")
    wanted = open_.select(F.explode(F.array("tail", "stem")).alias("context")).distinct()
    contexts = facts.filter("context is not null").select("context", "goes", "ends", "bare").join(wanted, "context", "left_semi")
    contexts = checkpoint(contexts.groupBy("context").agg(*(F.sum(c).alias(c) for c in ("goes", "ends", "bare"))))
    at = lambda name: contexts.select(F.col("context").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("goes", "ends", "bare")))
    count = lambda name: F.coalesce(F.col(name), F.lit(0))
    known = count("tail_ends") + count("tail_goes")
    # Unknown last words: cut within a word if the words before them are known and mostly go on otherwise.
    within = (count("stem_goes") >= 5) & (count("tail_bare") * 2 < count("stem_goes"))
    cut: Column = F.when(~F.col("lone") & (known >= 1), count("tail_ends") * 2 < known).otherwise(F.col("loose") | within)
    cut = open_.join(at("tail"), "tail", "left").join(at("stem"), "stem", "left").filter(cut).select(_ID, F.lit(True).alias("cut_tail"))

    declined = refusals(rows, _ID).withColumn("declines", F.lit(True))
    judged = rows.select(_ID, "empty", "copied", "cut", "foreign").join(cut, _ID, "left").join(declined, _ID, "left")
    defect = (
        F.when(F.col("empty"), "empty")
        .when(F.col("copied"), "copied")
        .when(F.col("cut") | F.coalesce("cut_tail", F.lit(False)), "truncated")
        .when(F.coalesce("declines", F.lit(False)), "refusal")
        .when(F.col("foreign"), "other_language")
    )
    return judged.select(F.col(_ID).alias(pair_id), defect.alias("defect")).filter("defect is not null")
