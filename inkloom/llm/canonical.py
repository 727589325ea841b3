"""Problem 5: one consistent form for text that looks the same.

Texts are exploded to positioned code points, joined with a (fixed-size, hence broadcast) table of decompositions,
blanks, invisible characters and look-alikes, combining marks are ordered by class within their cluster, clusters are
recomposed, and the strings rebuilt by position. Texts made of stable characters only are passed on as they are.

Folded: full- and half-width forms, all blanks to the space, composed and decomposed accents, Latin and Armenian
ligatures, invisible (format) characters, look-alike letters to Latin, look-alike hyphens to "-". Blanks at either
end are dropped. Kept apart: accents, case, punctuation, dashes, raised and other compatibility forms.
"""

from __future__ import annotations

import unicodedata as ud
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkloom.session import cut, is_blank, latest_blocks

#: Letters of other scripts drawn like a Latin one, and the Latin one.
LOOK_ALIKES = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s",
    "у": "y", "х": "x", "ѵ": "v", "ԝ": "w", "ӏ": "l", "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H",
    "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "У": "Y", "Ү": "Y",
    "Х": "X", "Ѵ": "V", "Ԝ": "W", "Ӏ": "I", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K",
    "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϳ": "j", "Ϲ": "C",
    "ϲ": "c", "օ": "o", "ɡ": "g", "ɑ": "a",
}

#: Hyphens drawn like "-", and characters without any ink that are not of the format class.
HYPHENS = "‐‑﹣－"
INKLESS = "͏ᅟᅠ឴឵ㅤﾠ" + "".join(map(chr, [*range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]))

FOLDED_TAGS = ("<wide>", "<narrow>", "<noBreak>")


@lru_cache(maxsize=None)
def folded(ch: str) -> str:
    """Full decomposition of one character: what the exploded rows hold instead of it."""
    if ch in LOOK_ALIKES:
        return LOOK_ALIKES[ch]
    if ch in HYPHENS:
        return "-"
    if ch in INKLESS or ud.category(ch) == "Cf":
        return ""
    if ud.category(ch) == "Zs":
        return " "
    tag, *codes = ud.decomposition(ch).split() or [""]
    ligature = tag == "<compat>" and "LIGATURE" in ud.name(ch, "") and 0xFB00 <= ord(ch) <= 0xFB17
    if not codes and not tag or tag.startswith("<") and not (tag in FOLDED_TAGS or ligature):
        return ch
    codes = codes if tag.startswith("<") else [tag, *codes]
    return "".join(folded(chr(int(c, 16))) for c in codes)


#: Assigned planes, without surrogates and private use.
CODES = [*range(0xD800), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)]


@lru_cache(maxsize=1)
def tables() -> tuple[list, dict[str, str], str]:
    """(mapping rows, recompositions of two characters, class of stable characters), all by rule."""
    pairs: dict[str, str] = {}
    joiners: set[str] = set()
    for code in CODES:
        ch = chr(code)
        parts = ud.decomposition(ch).split()
        if len(parts) == 2 and not parts[0].startswith("<") and ud.normalize("NFC", ch) == ch:
            first, second = (chr(int(p, 16)) for p in parts)
            first = folded(first) if ch not in LOOK_ALIKES else first
            first = ud.normalize("NFC", first) or first
            pairs.setdefault(first + second, ch if ud.normalize("NFC", first + second) == ch else ud.normalize("NFC", first + second))
            if ud.combining(second) == 0:
                joiners.add(second)
    joiners |= {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}
    rows, stable = [], []
    for code in CODES:
        ch = chr(code)
        f = folded(ch)
        mark = ud.combining(ch) > 0 or ch in joiners
        if f != ch or mark:
            rows.append((ch, [(c, ud.combining(c), not (ud.combining(c) or c in joiners)) for c in f]))
        if code < 0x2200 and not mark and ud.normalize("NFC", f) == ch and ch not in "\r\n":
            stable.append(code)
    spans, at = [], 0
    while at < len(stable):
        end = at
        while end + 1 < len(stable) and stable[end + 1] == stable[end] + 1:
            end += 1
        spans.append(f"\\u{stable[at]:04x}-\\u{stable[end]:04x}")
        at = end + 1
    return rows, pairs, "".join(spans)


def hangul(base: Column, mark: Column) -> Column:
    """A leading and a vowel jamo, or an open syllable and a final one, as a syllable; else null."""
    b, m = F.ascii(base), F.ascii(mark)
    lv = (b.between(0x1100, 0x1112)) & (m.between(0x1161, 0x1175))
    lvt = (b.between(0xAC00, 0xD7A3)) & ((b - 0xAC00) % 28 == 0) & (m.between(0x11A8, 0x11C2))
    code = F.when(lv, ((b - 0x1100) * 21 + m - 0x1161) * 28 + 0xAC00).when(lvt, b + m - 0x11A7)
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def recompose(cluster: Column, pairs: dict[str, str]) -> Column:
    """A cluster (array of (class, pos, sub, ch), the starter first, marks in order of class) as a string: each mark that
    nothing of its class or a higher one blocks is joined with the starter where a composed character exists."""
    marks: dict[str, dict[str, str]] = {}
    for pair, made in pairs.items():
        marks.setdefault(pair[-1], {})[pair[:-1]] = made
    table = lambda m: F.map_from_arrays(F.array(*map(F.lit, m)), F.array(*map(F.lit, m.values())))
    # by mark, then by starter: a search among some sixty, then among that mark's starters
    by_mark = F.map_from_arrays(F.array(*map(F.lit, marks)), F.array(*map(table, marks.values())))

    def step(state: Column, x: Column) -> Column:
        made = F.coalesce(F.try_element_at(F.try_element_at(by_mark, x["ch"]), state["base"]), hangul(state["base"], x["ch"]))
        joined = F.when((state["last"] < x["ccc"]) | (state["rest"] == ""), made)
        return F.struct(
            F.coalesce(joined, state["base"]).alias("base"),
            F.when(joined.isNull(), F.concat(state["rest"], x["ch"])).otherwise(state["rest"]).alias("rest"),
            F.when(joined.isNull(), x["ccc"]).otherwise(state["last"]).alias("last"),
        )

    first = cluster[0]
    start = F.struct(first["ch"].alias("base"), F.lit("").alias("rest"), F.lit(-1).alias("last"))
    done = F.aggregate(F.slice(cluster, 2, F.size(cluster)), start, step, lambda s: F.concat(s["base"], s["rest"]))
    return F.when(F.size(cluster) == 1, first["ch"]).otherwise(done)


def canonical_texts(df: DataFrame, keys: list[str], text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(keys, carry, canonical) of the rows of ``df``, whose keys are unique and not null. A null text stays null."""
    spark: SparkSession = df.sparkSession
    rows, pairs, stable = tables()
    keep = [*keys, *carry]
    text = F.col(text_col)
    # runs of stable characters stay together unless a character that may join theirs follows
    units = F.regexp_extract_all(text, F.lit(f"(?s)[{stable}]+(?![^{stable}])|."), F.lit(0))
    active = text.rlike(f"[^{stable}]")
    # a fixed table of the character standard, some four thousand rows: safe to broadcast
    mapping = F.broadcast(spark.createDataFrame(rows, "ch string, parts array<struct<ch:string,ccc:int,starts:boolean>>"))
    chars = df.select(*keep, F.posexplode(F.when(active, units).otherwise(F.array(text))).alias("pos", "ch"))
    own = F.array(F.struct(F.col("ch").alias("ch"), F.lit(0).alias("ccc"), F.lit(True).alias("starts")))
    parts = chars.join(mapping, "ch", "left").select(*keep, "pos", F.posexplode_outer(F.coalesce("parts", own)).alias("sub", "p"))
    # an invisible character leaves an empty string that starts nothing, so that no text is lost altogether
    gone = F.col("sub").isNull()
    parts = parts.select(
        *keep,
        "pos",
        "sub",
        F.when(gone, F.lit("")).otherwise(F.col("p.ch")).alias("ch"),
        F.when(gone, 0).otherwise(F.col("p.ccc")).alias("ccc"),
        (~gone & F.col("p.starts")).cast("int").alias("starts"),
    )
    line = Window.partitionBy(*keys).orderBy("pos", "sub")
    clusters = parts.withColumn("cluster", F.sum("starts").over(line)).groupBy(*keep, "cluster").agg(
        F.sort_array(F.collect_list(F.struct("ccc", "pos", "sub", "ch"))).alias("cl"),
    )
    strings = clusters.select(*keep, "cluster", recompose(F.col("cl"), pairs).alias("s"))
    whole = F.transform(F.sort_array(F.collect_list(F.struct("cluster", "s"))), lambda x: x["s"])
    return strings.groupBy(*keep).agg(whole.alias("all")).select(
        *keep,
        F.when(F.col("all")[0].isNotNull(), F.trim(F.array_join("all", ""))).alias("canonical"),
    )


def canonical_blocks(blocks: DataFrame) -> DataFrame:
    """(book_id, block_id, canonical) of every block, once; of differing repeated rows the greatest counts."""
    return canonical_texts(latest_blocks(blocks, "text"), ["book_id", "block_id"])


def look_alike_forms(blocks: DataFrame) -> DataFrame:
    """(book_id, block_id, t, c): unprotected, non-blank blocks with another one of their book that looks the same and
    differs as a string; ``t`` and ``c`` are 128-bit keys of the text and of its consistent form.

    Whether a form has several texts is told by the least and the greatest of them, however many blocks there are."""
    usable = latest_blocks(blocks, "text", "protected").where(~F.coalesce("protected", F.lit(False)) & ~is_blank(F.col("text")))
    key = lambda c: F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(7), c).alias("b"))
    forms = canonical_texts(usable.withColumn("t", key("text")), ["book_id", "block_id"], carry=("t",))
    forms = cut(forms.where("canonical <> ''").select("book_id", "block_id", "t", key("canonical").alias("c")))
    mixed = forms.groupBy("book_id", "c").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo <> hi").select("book_id", "c")
    return forms.join(mixed, ["book_id", "c"])


def look_alike_classes(blocks: DataFrame) -> DataFrame:
    """(book_id, block_id, representative, variant, blocks, variants): each such block once, with the least block of its
    class, the least block of exactly its own text, and how many blocks and different texts the class has."""
    kept = look_alike_forms(blocks)
    texts = kept.groupBy("book_id", "c", "t").agg(F.min("block_id").alias("variant"), F.count(F.lit(1)).alias("n"))
    classes = texts.groupBy("book_id", "c").agg(
        F.min("variant").alias("representative"),
        F.sum("n").alias("blocks"),
        F.count(F.lit(1)).alias("variants"),
    )
    rows = kept.join(texts.drop("n"), ["book_id", "c", "t"]).join(classes, ["book_id", "c"])
    return rows.select("book_id", "block_id", "representative", "variant", "blocks", "variants")


def look_alike_pairs(blocks: DataFrame) -> DataFrame:
    """(book_id, block_a, block_b): unprotected, non-blank blocks of a book that look the same and differ as strings.

    Distinct texts are paired first and expanded to their blocks after, so that exact copies are never paired. The number
    of rows is that of the pairs asked for; ``look_alike_classes`` has the same links with a row a block."""
    kept = look_alike_forms(blocks)
    variants = kept.select("book_id", "c", "t").distinct()
    a, b = variants.withColumnRenamed("t", "ta"), variants.withColumnRenamed("t", "tb")
    pairs = a.join(b, ["book_id", "c"]).where("ta < tb").select("book_id", "ta", "tb")
    left = kept.select("book_id", F.col("t").alias("ta"), F.col("block_id").alias("x"))
    right = kept.select("book_id", F.col("t").alias("tb"), F.col("block_id").alias("y"))
    got = pairs.join(left, ["book_id", "ta"]).join(right, ["book_id", "tb"])
    return got.select("book_id", F.least("x", "y").alias("block_a"), F.greatest("x", "y").alias("block_b"))
