"""Problem 1: broken source-translation (prompt-response) pairs.

Every saved translation in force gets at most one defect, in this order: ``empty``, ``refusal``, ``copied``,
``wrong_language``, ``truncated``.

* empty: nothing readable, unless the source has nothing readable either and the answer shows some sign.
* refusal: a grammar of sentences (inability or declining, with the task as its object) in two dozen languages.
* copied: greedy string tiling over words: tiles of the source cover it and most of the answer.
* wrong_language: script, and words that belong to one language (learned from a bounded sample of the translations by
  their target language), speak for a language that is neither source nor target.
* truncated: a pushdown automaton follows tags, brackets, quotations, fences and list items of both sides; an answer
  that ends inside a construct the source closes, breaks off on an ellipsis or comma, ends without a stop, or has
  fewer sentences, list items, tags or placeholders than the source, was cut; signs that also occur in whole answers
  count where it is shorter than the pair of languages usually makes it.

Defined results: pairs whose source block is unknown are judged on the answer alone (empty, refusal); sources without
words have no copied, wrong_language or truncated answers; of repeated rows of one key the latest saved counts, then
the greatest; rows without key are left out.
"""

from __future__ import annotations

import math
import pickle
import re
import unicodedata as ud
from collections import Counter
from functools import lru_cache

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.llm.language import label_language
from inkloom.session import checked_broadcast, latest_blocks, spread, stored

#: For each language, phrases of inability or declining, and of the task that is declined.
REFUSAL_GRAMMAR = {
    "en": (
        r"can't|cannot|can not|unable to|not able to|not allowed|not permitted|won't be able|declin\w+|refuse\w*|reject\w*|isn't possible|is not possible|not possible",
        r"translat\w*|this (?:text|passage|excerpt|request|content|material)|what you sent",
    ),
    "es": (
        r"no puedo|no me es posible|no es posible|no tengo permitido|no se me permite|no estoy autorizad\w+|rechaz\w+|negarme|declin\w+|me resulta imposible|es imposible",
        r"traduc\w+|traducir\w*|este (?:texto|pasaje|contenido|fragmento|material)|esta (?:solicitud|petición)",
    ),
    "pt": (
        r"não posso|não me é permitido|não me é possível|não é possível|não consigo|não estou autorizad\w+|recus\w+|declin\w+|é impossível",
        r"tradu\w+|(?:d?est[ea]|ess[ea]) (?:texto|trecho|conteúdo|pedido|material|solicitação)",
    ),
    "fr": (
        r"ne peux pas|ne puis|impossible de|n'est pas possible|refus\w+|déclin\w+|ne suis pas autorisée?|ne suis pas en mesure|ne m'est pas permis",
        r"tradu\w+|ce (?:texte|passage|contenu|document)|cet extrait|cette (?:demande|requête)",
    ),
    "de": (
        r"kann\b.*\bnicht|darf\b.*\bnicht|nicht möglich|unmöglich|ablehn\w+|abzulehnen|verweiger\w*|lehne\b.*\bab|nicht gestattet|nicht in der lage",
        r"übersetz\w*|diese[nsr]? (?:text\w*|inhalt\w*|anfrage|abschnitt\w*|passage)",
    ),
    "it": (
        r"non posso|non mi è possibile|non è possibile|non sono autorizzat\w+|non sono in grado|non riesco|rifiut\w+|declin\w+|impossibile",
        r"tradu\w+|quest[oa] (?:testo|brano|contenuto|richiesta|passaggio|materiale)",
    ),
    "nl": (
        r"kan\b.*\bniet|kan geen|mag\b.*\bniet|niet mogelijk|onmogelijk|weiger\w*|niet in staat|niet toegestaan",
        r"verta\w+|deze (?:tekst|passage|inhoud|vraag)|dit (?:fragment|verzoek|materiaal)",
    ),
    "sv": (
        r"kan\b.*\binte|får\b.*\binte|omöjligt|vägra\w*|inte möjligt|inte tillåt\w+",
        r"översätt\w*|den här (?:texten|passagen|begäran)|det här (?:innehållet|stycket|materialet)|denna (?:text|begäran)",
    ),
    "da": (
        r"kan\b.*\bikke|må\b.*\bikke|umuligt|nægte\w*|afvise\w*|ikke muligt|ikke tilladt",
        r"oversæt\w*|denne (?:tekst|passage|anmodning)|dette (?:indhold|afsnit|materiale)",
    ),
    "no": (
        r"kan\b.*\bikke|får\b.*\bikke|umulig|nekte\w*|avslå\w*|ikke mulig|ikke tillatt",
        r"oversett\w*|denne (?:teksten|passasjen|forespørselen)|dette (?:innholdet|avsnittet|materialet)",
    ),
    "pl": (
        r"nie mogę|nie jestem w stanie|nie wolno mi|niemożliwe|odmawiam|odmówić|nie jest możliwe",
        r"(?:prze)?tłumacz\w*|przetłumaczyć|(?:tego|ten) (?:tekst\w*|fragment\w*)|tej (?:treści|prośby)|tę prośbę",
    ),
    "cs": (
        r"nemohu|nemůžu|nesmím|nelze|není možné|odmítám|odmítnout|nejsem schop\w+",
        r"přel[oož]\w+|překl\w+|tento (?:text|úryvek|požadavek|obsah)|tuto (?:žádost|pasáž)",
    ),
    "ro": (
        r"nu pot|nu am voie|nu este posibil|imposibil|refuz\w*|nu sunt autorizat\w*",
        r"tradu\w+|acest (?:text|fragment|conținut)|această (?:solicitare|cerere)",
    ),
    "hu": (
        r"nem tudom|nem tudok|nem lehet\w*|nem áll módomban|visszautasít\w*|megtagad\w*",
        r"fordít\w*|lefordít\w*|(?:ezt|ennek) a[z]? (?:szöveg\w*|kérés\w*|tartal\w*|részlet\w*)",
    ),
    "fi": (
        r"en voi|en pysty|en saa|ei ole mahdollista|mahdotonta|kieltäydy\w*",
        r"kään\w+|tätä (?:tekstiä|sisältöä|kohtaa)|tä(?:hän|män) (?:pyyntö\w*|teksti\w*)",
    ),
    "tr": (
        r"emem\b|amam\b|emiyorum\b|amıyorum\b|emeyeceğim\b|amayacağım\b|mümkün değil|imkansız|redded|reddet",
        r"çevir\w*|çeviri\w*|tercüme\w*|bu (?:metn\w*|metin|içeri\w*|isteğ\w*|istek)",
    ),
    "el": (
        r"δεν μπορώ|δεν μου επιτρέπεται|αδύνατο\w*|αρνούμαι|δεν είναι δυνατ\w+",
        r"μεταφρ\w+|αυτ\w+ τ\w+ (?:κείμεν\w+|απόσπασμ\w+|περιεχόμεν\w+|αίτημ\w+)",
    ),
    "uk": (r"не можу|неможливо|не маю права|не дозволено|відмовля\w+|відхил\w+", r"перекла\w+|ц\w+ (?:текст\w*|урив\w+|запит\w*|вміст\w*)"),
    "ja": (r"できません|できかねます|お断り|いたしかねます|不可能|対応でき", r"翻訳|訳すこと|この(?:文章|テキスト|依頼|内容|リクエスト)"),
    "zh": (r"无法|無法|不能|不可以|拒绝|拒絕|不允许|不被允許", r"翻译|翻譯|(?:这|這|此)(?:段|个|個|份)?(?:文本|内容|內容|文字|请求|請求)"),
    "ko": (r"수 없습니다|수 없어요|불가능|거절|거부|못합니다", r"번역|이 (?:글|텍스트|내용|요청|본문)"),
    "ar": (r"لا أستطيع|لا يمكنني|لا يمكن|غير مسموح|أرفض|أعتذر عن|يتعذر", r"ترجم\w*|الترجمة|هذا (?:النص|المحتوى|الطلب|المقطع)"),
    "ru": (
        r"не могу|нельзя|невозможно|не имею права|не разрешено|не в состоянии|не удастся|отказ\w+|отклон\w+",
        r"перев[оеё]\w+|эт\w+ (?:текст\w*|отрыв\w+|запрос\w*|содержим\w+|просьб\w+|материал\w*)|вашу просьбу",
    ),
}

#: Languages whose words are not looked for as whole ones: without blanks between words, or told by their endings.
RUN_ON = {"ja", "zh", "ko", "tr"}
REFUSALS = {
    k: (re.compile(a), re.compile(b)) if k in RUN_ON else (re.compile(rf"\b(?:{a})(?!\w)"), re.compile(rf"\b(?:{b})")) for k, (a, b) in REFUSAL_GRAMMAR.items()
}


@lru_cache(maxsize=1)
def stems():
    """An automaton over the literal beginnings of all phrases of inability, each with the languages that have it: most
    answers hold none, and need no grammar."""
    found: dict[str, set[str]] = {}
    for language, (inability, _) in REFUSAL_GRAMMAR.items():
        for phrase in inability.split("|"):
            # up to the first character that stands for others, or may be missing
            found.setdefault(re.match(r"(?:[^\\.*+?(\[](?![?*]))+", phrase).group(), set()).add(language)
    automaton = ahocorasick.Automaton()
    for stem, languages in found.items():
        automaton.add_word(stem, tuple(sorted(languages)))
    automaton.make_automaton()
    return automaton


SENTENCE_END = re.compile(r"(?<=[.?!])\s|(?<=[。？！])")

#: What opens and what closes a construct.
CLOSERS = {
    ")": ("(",),
    "]": ("[",),
    "}": ("{",),
    "”": ("“", "„"),
    "»": ("«",),
    "“": ("„",),
    "’": ("‘", "‚"),
    "‘": ("‚",),
    "›": ("‹",),
    "」": ("「",),
    "』": ("『",),
    "）": ("（",),
    "】": ("【",),
}
OPENERS = set("([{“«„‘‚‹「『（【")
TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)[^<>]*?(/?)>")
VOID = {"br", "hr", "img", "wbr"}
#: Tokens of the pushdown parser; a line of a fence or a list item starts its line.
TOKEN = re.compile(
    r"(?m)^[ \t]*(?P<fence>```|~~~)|^[ \t]*(?P<item>[-*•]|\d+[.)])(?=[ \t]|$)|(?P<tag><(?P<end>/?)(?P<name>[A-Za-z][A-Za-z0-9]*)[^<>]*?(?P<void>/?)>)"
    r"|(?P<hole>\{\{\d+\}\})|(?P<half><[A-Za-z/][^<>]*\Z|\{\{?\d*\Z)|(?P<sign>[()\[\]{}“”«»„‘’‚‹›「」『』（）【】\"])"
)
BARE_ITEM = re.compile(r"(?m)^[ \t]*(?:[-*•]|\d+[.)])\s*\Z")
#: A text without any of these holds no token.
STRUCTURE = re.compile(r"[<{}()\[\]“”«»„‘’‚‹›「」『』（）【】\"`~*•]|(?m:^[ \t]*(?:-|\d+[.)])(?=[ \t]|$))")
HOLE = re.compile(r"\{\{\d+\}\}")
HOLE_END = re.compile(r"\{\{\d+\}\}\Z")
ENTITY = re.compile(r"&(?:#\d+|#x[0-9a-fA-F]+|[A-Za-z]+);")
WORD = re.compile(r"\w+")
CUT_END = re.compile(r"(?:\[?\s*(?:\.{2,}|…)\s*\]?|[,;:—–-])\s*$")
STOP = re.compile(r"[.!?…]+[\"'”“»’)\]]*(?=\s+[^\s{)\],;:a-zß-öø-ÿа-яё]|\s*$)")
LETTER = re.compile(r"[^\W_]")
SMALL = re.compile(r"\b[a-zß-öø-ÿœа-яё]{2,}")
LETTERS = re.compile(r"[^\W\d_]{2,}")
STOP_END = re.compile(r"[.!?…][\"'”“»’)\]\s]*$")

#: The script each language is written in, and what finds letters outside of a script.
SCRIPTS = {"en": "LATIN", "es": "LATIN", "pt": "LATIN", "fr": "LATIN", "de": "LATIN", "it": "LATIN", "ru": "CYRILLIC"}
OUTSIDE = {"LATIN": re.compile(r"[^\W\d_A-Za-zªºÀ-ÖØ-öø-ʯḀ-ỿ]"), "CYRILLIC": re.compile(r"[^\W\d_Ѐ-ԯ]")}
#: One letter tells no script of an answer.
LEAST_LETTERS = 2

#: The word table is learned from at most so many translations, chosen by hash; it has at most so many words.
TRAIN_ROWS = 9000
TRAIN_WORDS = 20_000
#: Least evidence (nats) for a language, and greatest share of it that the target may have.
SURE = 4.0
STILL_TARGET = 0.3
#: Tiles shorter than this many words are left to chance; shares that tiles must cover of the source and the answer.
LEAST_TILE = 3
COPY_OF_SOURCE, COPY_OF_ANSWER = 0.85, 0.7
#: Shares of the usual length that speak for a cut beside another sign: a broken-off end, fewer sentences, no stop (a
#: missing one alone is no defect), and lost markup without any other sign.
LONG, FEWER, NO_STOP, VERY_SHORT = 1.15, 0.9, 0.76, 0.6


def readable(text: str) -> bool:
    """Whether there are letters or digits outside of markup, entities and placeholders."""
    return bool(LETTER.search(ENTITY.sub(" ", HOLE.sub(" ", TAG.sub(" ", text)))))


def shows(text: str) -> bool:
    """Whether anything at all is visible."""
    t = TAG.sub(" ", text)
    for name in ("&nbsp;", "&#160;", "&ensp;", "&emsp;", "&thinsp;"):
        t = t.replace(name, " ")
    return any(not (c.isspace() or ud.category(c) in ("Cf", "Cc", "Mn", "Zs")) for c in t)


def is_empty(answer: str | None, source: str | None) -> bool:
    if answer is None:
        return True
    if LETTER.search(answer) and not ("<" in answer or "&" in answer or "{" in answer) or readable(answer):
        return False
    return not shows(answer) or bool(source) and readable(source)


def declines(text: str) -> bool:
    """Whether some sentence of a text declines the task, in one of the grammar's languages."""
    t = text.casefold().replace("’", "'")
    t = " ".join((TAG.sub(" ", t) if "<" in t else t).split())
    languages = {k for _, ks in stems().iter(t) for k in ks}
    if not languages:
        return False
    for a, b in (REFUSALS[k] for k in sorted(languages)):
        if b.search(t) and any(a.search(s) and b.search(s) for s in SENTENCE_END.split(t)):
            return True
    return False


def is_refusal(answer: str, source: str | None) -> bool:
    """Some sentence declines the task; the source does not say the same."""
    return declines(answer) and not (source and declines(source))


def words(text: str) -> list[str]:
    return WORD.findall(ud.normalize("NFKC", ENTITY.sub(" ", HOLE.sub(" ", TAG.sub(" ", text)))).casefold())


PRIME = (1 << 61) - 1


def longest_common(
    a: list[int],
    b: list[int],
    sums: tuple[list[int], list[int]],
    powers: list[int],
    free: tuple[list[int], list[int]],
    low: int,
    high: int,
) -> tuple[int, list[tuple[int, int]]]:
    """Length of the longest run that stands in the free parts of both, within [low, high], and its places. That a run of
    some length exists is monotone in the length, so it is searched by halving, each step by hashes of all windows."""
    best: tuple[int, list[tuple[int, int]]] = (0, [])
    while low <= high:
        n = (low + high) // 2
        seen: dict[int, list[int]] = {}
        for i in range(len(a) - n + 1):
            if free[0][i] >= n:
                seen.setdefault((sums[0][i + n] - sums[0][i] * powers[n]) % PRIME, []).append(i)
        spots = []
        for j in range(len(b) - n + 1):
            if free[1][j] >= n:
                i = next((i for i in seen.get((sums[1][j + n] - sums[1][j] * powers[n]) % PRIME, ())), None)
                if i is not None and a[i : i + n] == b[j : j + n]:
                    spots.append((i, j))
                    # one place of a is used once at this length
                    seen[(sums[1][j + n] - sums[1][j] * powers[n]) % PRIME].pop(0)
        if spots:
            best, low = (n, spots), n + 1
        else:
            high = n - 1
    return best


def free_lengths(taken: list[bool]) -> list[int]:
    """For each place, how many places from it on are free."""
    out, n = [0] * len(taken), 0
    for i in range(len(taken) - 1, -1, -1):
        n = 0 if taken[i] else n + 1
        out[i] = n
    return out


def tiles(a: list[str], b: list[str], least: int) -> int:
    """Words covered by greedy string tiling: longest common runs first, none overlapping.

    Lengths fall from round to round and tiles do not overlap, so there are at most about sqrt(2 n) rounds of
    O(n log n)."""
    number: dict[str, int] = {}
    x, y = ([number.setdefault(w, len(number) + 1) for w in words] for words in (a, b))
    sums = []
    for words in (x, y):
        acc = [0]
        for w in words:
            acc.append((acc[-1] * 1_000_003 + w) % PRIME)
        sums.append(acc)
    powers = [1]
    for _ in range(min(len(x), len(y))):
        powers.append(powers[-1] * 1_000_003 % PRIME)
    taken = [False] * len(x), [False] * len(y)
    high, covered = min(len(x), len(y)), 0
    while high >= least:
        n, spots = longest_common(x, y, (sums[0], sums[1]), powers, (free_lengths(taken[0]), free_lengths(taken[1])), least, high)
        if not spots:
            break
        for i, j in spots:
            if not any(taken[0][i : i + n]) and not any(taken[1][j : j + n]):
                taken[0][i : i + n] = [True] * n
                taken[1][j : j + n] = [True] * n
                covered += n
        high = n
    return covered


def has_words(source: str) -> bool:
    """Something to translate: a word that is no name, number or sign."""
    bare = ENTITY.sub(" ", HOLE.sub(" ", TAG.sub(" ", source)))
    if SMALL.search(bare):
        return True
    bare = ud.normalize("NFKC", bare)
    return bool(SMALL.search(bare)) or sum(w.isupper() for w in LETTERS.findall(bare)) >= 3


def is_copy(source: str, answer: str) -> bool:
    a, b = words(source), words(answer)
    if not a or not b:
        return False
    # tiles cover at most the words both have: an exact bound that spares nearly all pairs the tiling
    counts: dict[str, int] = {}
    for w in b:
        counts[w] = counts.get(w, 0) + 1
    shared = 0
    for w in a:
        if counts.get(w, 0) > 0:
            counts[w] -= 1
            shared += 1
    if shared < COPY_OF_SOURCE * len(a) or shared < COPY_OF_ANSWER * len(b) or not has_words(source):
        return False
    if a == b:
        return True
    n = tiles(a, b, min(LEAST_TILE, len(a)))
    return n >= COPY_OF_SOURCE * len(a) and n >= COPY_OF_ANSWER * len(b)


def parsed(text: str) -> tuple[int, int, int, int]:
    """(constructs open at the end, list items, tags, placeholders) by a pushdown automaton over tags, fences, list items,
    brackets and quotations.

    Within a fence only its end counts. A straight quotation mark opens before a word and closes the one that is open.
    A list item is open if the text ends before anything stands in it. What ends in the middle of a tag or placeholder is open too."""
    stack: list[str] = []
    items = tags = holes = 0
    if not STRUCTURE.search(text):
        return 0, 0, 0, 0
    for m in TOKEN.finditer(text):
        kind = m.lastgroup if m.lastgroup not in ("end", "name", "void") else "tag"
        if kind == "fence":
            if m.group("fence") in stack:
                while stack.pop() != m.group("fence"):
                    pass
            else:
                stack.append(m.group("fence"))
            continue
        if stack and stack[-1] in ("```", "~~~"):
            holes += kind == "hole"
            continue
        if kind == "item":
            items += 1
        elif kind == "tag":
            tags += 1
            name = m.group("name").lower()
            if m.group("void") or name in VOID:
                continue
            if not m.group("end"):
                stack.append(f"<{name}")
            elif f"<{name}" in stack:
                while stack.pop() != f"<{name}":
                    pass
        elif kind == "hole":
            holes += 1
        elif kind == "half":
            stack.append("half")
        elif kind == "sign":
            c, at = m.group("sign"), m.start()
            if c == '"':
                if c in stack:
                    while stack.pop() != c:
                        pass
                elif (at == 0 or not text[at - 1].isalnum()) and at + 1 < len(text) and not text[at + 1].isspace():
                    stack.append(c)
                continue
            opener = next((o for o in CLOSERS.get(c, ()) if o in stack), None)
            if opener is not None:
                while stack.pop() != opener:
                    pass
            elif c in OPENERS:
                stack.append(c)
    bare = not any(f in stack for f in ("```", "~~~")) and bool(BARE_ITEM.search(text))
    return len(stack) + bare, items, tags, holes


def open_at_end(text: str) -> int:
    return parsed(text)[0] + bool(re.search(r"\{\{\d+\}\}\Z", text))


def sentence_count(text: str) -> int:
    n = len(STOP.findall(text))
    return n + (not STOP_END.search(text))


def is_truncated(source: str, answer: str, usual: float | None) -> bool:
    """Judged by how the answer ends, what it leaves out, and its length against the usual one for its languages."""
    s, t = source.rstrip(), answer.rstrip()
    if not has_words(source):
        return False
    share = len(t) / max(1.0, len(s) * (usual or 1.0))
    (open_s, *have), (open_t, *got) = parsed(s), parsed(t)
    lost = any(g < h for g, h in zip(got, have))
    stops, stopped = bool(STOP_END.search(s)), bool(STOP_END.search(t))
    if CUT_END.search(t) and not CUT_END.search(s) or open_t > open_s or HOLE_END.search(t) and not HOLE_END.search(s) and not stopped and stops:
        return share < LONG or open_t > open_s
    if stops and not stopped and (lost or share < NO_STOP):
        return True
    if sentence_count(TAG.sub("", t)) < sentence_count(TAG.sub("", s)):
        return share < FEWER or lost or stops and not stopped and share < LONG
    return share < VERY_SHORT and lost


@lru_cache(maxsize=None)
def script_of(letter: str) -> str:
    name = ud.name(letter, "").split(" ")[0]
    return "CJK" if name in ("HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA") else name


def script(text: str) -> str | None:
    """The script of most letters outside of markup, entities and placeholders."""
    bare = ud.normalize("NFKC", ENTITY.sub(" ", HOLE.sub(" ", TAG.sub(" ", text))))
    counts = Counter(script_of(c) for c in bare if c.isalpha())
    n = sum(counts.values())
    best = max(counts, key=counts.get) if n >= LEAST_LETTERS else None
    return best if best and counts[best] > 0.5 * n else None


def in_other_script(source: str, answer: str, target: str | None, label: str | None) -> bool:
    """Whether the answer is in a script of neither the target nor the source."""
    own = SCRIPTS.get(target)
    if own is None or not OUTSIDE[own].search(answer):
        return False
    got = script(answer)
    return got is not None and got not in (own, SCRIPTS.get(label), script(source))


class WordTable:
    """Words that belong to one language more than to any other, with their weight."""

    def __init__(self, weights: dict[str, tuple[str, float]]):
        self.weights = weights

    @classmethod
    def learn(cls, texts: list[str], languages: list[str]) -> WordTable:
        counts: dict[str, dict[str, int]] = {}
        totals: dict[str, int] = {}
        for t, lang in zip(texts, languages):
            for w in set(small_words(t)):
                own = counts.setdefault(w, {})
                own[lang] = own.get(lang, 0) + 1
                totals[lang] = totals.get(lang, 0) + 1
        kept = sorted((w for w, c in counts.items() if sum(c.values()) >= 3), key=lambda w: (-sum(counts[w].values()), w))[:TRAIN_WORDS]
        weights = {}
        for w in kept:
            share = sorted((((counts[w].get(k, 0) + 0.5) / (n + 1), k) for k, n in totals.items()), reverse=True)
            gain = math.log(share[0][0] / share[1][0]) if len(share) > 1 else 1.0
            if gain > 0.7:
                weights[w] = (share[0][1], min(gain, 3.0))
        return cls(weights)

    def scores(self, text: str) -> dict[str, float]:
        out: dict[str, float] = {}
        get = self.weights.get
        for w in small_words(text):
            hit = get(w)
            if hit:
                out[hit[0]] = out.get(hit[0], 0.0) + hit[1]
        return out

    def language(self, text: str | None) -> str | None:
        got = self.scores(text) if text else None
        if not got:
            return None
        best = max(got, key=got.get)
        return best if got[best] >= SURE and got[best] >= 0.7 * sum(got.values()) else None

    def against(self, text: str, target: str | None) -> tuple[bool, str | None]:
        """Whether the text is surely in the target language; the language it is in if that is surely another."""
        got = self.scores(text)
        if not got or target is None:
            return False, None
        best = max(got, key=got.get)
        if best == target:
            return got[best] >= SURE and got[best] >= 0.9 * sum(got.values()), None
        sure = got[best] >= SURE and got.get(target, 0.0) <= STILL_TARGET * got[best]
        return False, best if sure else None


def small_words(text: str) -> list[str]:
    """The words that are no names; of a text in capitals, all."""
    found = SMALL.findall(text)
    return found or [w.lower() for w in LETTERS.findall(text) if w.isupper()]


def defect(source: str | None, answer: str | None, target: str | None, label: str | None, table: WordTable, usual: dict) -> str | None:
    if is_empty(answer, source):
        return "empty"
    if is_refusal(answer, source):
        return "refusal"
    if not source:
        return None
    settled, other = table.against(answer, target)
    own = table.language(source)
    known = own or label
    # an answer in the target language copies nothing, unless the source is in that language as well
    if not settled and is_copy(source, answer) and (known or "?") != target:
        return "copied"
    if (in_other_script(source, answer, target, label) or other and other != own) and has_words(source):
        return "wrong_language"
    return "truncated" if is_truncated(source, answer, usual.get((known, target))) else None


def pairs(state: DataFrame, runs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(state_key, block_id, source, answer, target, label): every translation in force with its source block.

    Saved rows get their book before the latest is taken, so that one exchange by (book_id, block_id) serves both that
    and the join with the blocks."""
    r = runs.where("state_key is not null").groupBy("state_key").agg(F.max(F.struct("book_id", "source_language", "target_language")).alias("r"))
    r = r.select(
        "state_key",
        "r.book_id",
        label_language(F.col("r.source_language")).alias("label"),
        label_language(F.col("r.target_language")).alias("target"),
    )
    rows = state.where("state_key is not null and block_id is not null").select("state_key", "block_id", "text", "saved_at").join(r, "state_key", "left")
    keys = ["book_id", "block_id"]
    latest = spread(rows, *keys).groupBy(*keys, "state_key", "label", "target").agg(F.max(F.struct("saved_at", "text")).alias("t"))
    b = latest_blocks(blocks, "text").withColumnRenamed("text", "source")
    return latest.join(b, keys, "left").select("state_key", "block_id", "source", F.col("t.text").alias("answer"), "target", "label")


def broken_pairs(state: DataFrame, runs: DataFrame, blocks: DataFrame, bound: int = TRAIN_ROWS) -> DataFrame:
    """(state_key, block_id, defect) of the defective pairs in force."""
    spark = state.sparkSession
    rows = stored(pairs(state, runs, blocks), "pairs")
    sample = rows.where("target is not null and length(answer) between 12 and 4000").select("answer", "target").orderBy(F.xxhash64("state_key", "block_id"), "answer").limit(bound).toArrow()
    table = WordTable.learn(sample.column("answer").to_pylist(), sample.column("target").to_pylist())
    shared = checked_broadcast(spark, table, len(pickle.dumps(table)))

    # the usual length of an answer against its source, for each pair of languages: at most as many rows as such pairs
    @F.pandas_udf("string")
    def source_language(source: pd.Series) -> pd.Series:
        return source.map(shared.value.language)

    ratios = rows.where("target is not null and length(source) > 0 and length(answer) > 0").select(
        F.coalesce(source_language("source"), "label").alias("known"),
        "target",
        (F.length("answer") / F.length("source")).alias("ratio"),
    )
    medians = ratios.where("known <> target").groupBy("known", "target").agg(F.percentile_approx("ratio", 0.5, 1000).alias("usual")).collect()
    usual = {(m.known, m.target): m.usual for m in medians}

    def run(batches):
        for batch in batches:
            c = [batch.column(k).to_pylist() for k in ("source", "answer", "target", "label")]
            found = [defect(s, a, t, k, shared.value, usual) for s, a, t, k in zip(*c)]
            keep = pa.array([d is not None for d in found])
            out = pa.RecordBatch.from_arrays(
                [batch.column("state_key"), batch.column("block_id"), pa.array(found, pa.string())],
                ["state_key", "block_id", "defect"],
            )
            yield out.filter(keep)

    return rows.mapInArrow(run, "state_key string, block_id long, defect string")
