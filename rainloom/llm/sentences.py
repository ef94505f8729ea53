"""Sentence units across languages and scripts (problem 10), in SQL expressions only.

Terminators that end nothing (in decimals, addresses, initials, abbreviations and quotations) are replaced by
private-use characters of the same length; a marker is put after each terminator that is left, by rules that
depend on the script; the text is split at the markers.  As every replacement keeps the length, positions are
running sums of part lengths, and as every stand-in stands for one character, each part is restored by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Private-use stand-ins, one for one character each: masked terminators and the blank of Thai quotations, the
# boundary, and quotation marks: per pair of marks one each for opening and closing, plain and led by a colon.
_TERMS = ".!?…。！？؟।"
_MASKED = "".join(chr(0xE000 + i) for i in range(len(_TERMS)))
_CUT, _HELD, _END, _EITHER = "\ue010", "\ue011", "\ue012", "\ue013"
_DOT = _MASKED[0]
# pairs of marks; the last three stand in wrongly decoded texts, three characters each or all the same character
_PAIRS = [("„", "“"), ("„", "”"), ("“", "”"), ("«", "»"), ("「", "」"), ("『", "』"), ("‹", "›"), ('"', '"'), ("â€œ", "â€\u009d"), ("â€ž", "â€œ"), ("\ufffd", "\ufffd")]
_stand = lambda base: [chr(base + i) for i in range(len(_PAIRS))]
_OPENS, _OPENS_LED, _CLOSES, _CLOSES_LED = _stand(0xE020), _stand(0xE030), _stand(0xE040), _stand(0xE050)
_TAILS = {"€": "\ue060", "œ": "\ue061", "\u009d": "\ue062", "ž": "\ue063"}
_OPEN, _CLOSE, _CLOSE_LED = "\ue020-\ue03f", "\ue040-\ue05f", "\ue050-\ue05f"
_RESTORE = {**dict(zip(_MASKED, _TERMS)), _HELD: " ", **{v: k for k, v in _TAILS.items()}}
for _i, (_a, _b) in enumerate(_PAIRS):
    _RESTORE |= {_OPENS[_i]: _a[0], _OPENS_LED[_i]: _a[0], _CLOSES[_i]: _b[0], _CLOSES_LED[_i]: _b[0]}
# private-use characters of the text itself step aside while the stand-ins are there
_OWN = "".join(chr(0xE000 + i) for i in range(0x64))
_ASIDE = "".join(chr(0xF0000 + i) for i in range(0x64))
#: Characters that no unit begins or ends with.
BLANKS = " \t\n\r\x0b\f\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_BREAK = "\\r\\n\\u0085\\u2028\\u2029\\u000B\\f"

# Abbreviations.  Those of the first list never end a sentence, those of the second not
# before a figure or a small letter, those of the third not before a small letter.
NEVER = (
    "dr|drs|mr|mrs|ms|prof|st|ste|sr|sra|srta|dra|mme|mlle|mm?e|messrs|hr|fr|frl|rev|gen|col|capt|lt|sgt|e\\.g|i\\.e|e\\. g|i\\. e|p\\. ?ex|p\\. ?ej|c\\.-.{1,2}-d|z\\. ?b|d\\. ?h|u\\. ?a|bzw|ca|vgl|sog|"
    "approx|aprox|approximadamente|env|vs|cf|avda|δηλ|περ|π\\.χ|βλ|κ|डॉ|श्री|ver|v"
)
BEFORE_FIGURE = (
    "fig|figs|no|nos|nr|nº|num|núm|vol|art|abb|pág|págs|pag|pp?|s|σελ|αρ|ch|sec|eq|tab|jan|janv|feb|fév|févr|mar|apr|avr|jun|juil|jul|aug|sep|sept|oct|okt|nov|dec|déc|dez|ene|abr|ago|dic|fev|set|out"
)
BEFORE_SMALL = "etc|inc|ltd|ltda|co|corp|jr|usw|ave|av|blvd|rd|gmbh|p\\.m|a\\.m|p\\. ?m|a\\. ?m|h|m|μ\\.μ|π\\.μ|χιλ|mm|cm|km|kg|min|sek|u\\.k|u\\.s|s\\. ?a|e\\. ?v|κ\\.λπ|κ\\.ά"
_MONTHS = "Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"


def _swap(text: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(to))


class _Steps:
    """A chain of replacements on one column; each step is a projection of its own, so no text is worked on twice."""

    def __init__(self, df: DataFrame, column: str):
        self.df, self.column = df, column

    def swap(self, *pairs: tuple[str, str], has: str = "", where: str | None = None) -> None:
        """Apply the replacements in turn; only to texts that hold one of the characters ``has`` and match ``where``.

        Looking for a character is far cheaper than a pattern, and a pattern that begins with a plain
        character far cheaper than one that begins with a class; hence the guards and the shape of the patterns.
        """
        x = F.col(self.column)
        out = x
        for pattern, to in pairs:
            out = _swap(out, pattern, to)
        self.apply(out, has, where)

    def apply(self, out: Column, has: str = "", where: str | None = None) -> None:
        x = F.col(self.column)
        guard = None
        for c in has:
            one = F.contains(x, F.lit(c))
            guard = one if guard is None else guard | one
        if where:
            guard = x.rlike(where) if guard is None else guard & x.rlike(where)
        self.df = self.df.withColumn(self.column, out if guard is None else F.when(guard, out).otherwise(x))


def _quotes(x: _Steps) -> None:
    """Paired quotation marks as stand-ins; pairs led by a colon get their own.  Terminators inside are masked.

    A quotation ends with its line at the latest, and may be as long.
    """
    body = lambda marks: f"([^{marks}{_BREAK}]++)"
    decoded = f"((?:[^â{_BREAK}]|â(?!€[œž\u009d]))++)"
    bodies = {"„": body("„“”"), "“": body("“”„"), "«": body("«»"), "「": body("「」"), "『": body("『』"), "‹": body("‹›")}
    for i, (o, c) in enumerate(_PAIRS[:-1]):
        tail = lambda mark: "".join(_TAILS[k] for k in mark[1:])
        if o == '"':
            rest = f"(?=[^\\s\"])([^\"{_BREAK}]++)(?<=[^\\s])\"(?=[\\s.,;:!?)…।]|$|\\p{{Lu}})"
        else:
            rest = f"{bodies.get(o, decoded)}{c}"
        x.swap((f"{o}(?<=[:：] ?{o}){rest}", f"{_OPENS_LED[i]}{tail(o)}$1{_CLOSES_LED[i]}{tail(c)}"), (f"{o}{rest}", f"{_OPENS[i]}{tail(o)}$1{_CLOSES[i]}{tail(c)}"), has=o[:1])
    # one character for both marks: what may close, and what may open as well, is told first; what follows a line's
    # last such mark opens nothing, so that no stretch is searched twice
    last, mark, opens, closes = len(_PAIRS) - 1, f"[{_END}{_EITHER}]", f"(?= ?[\\p{{Lu}}\ufffd])", "(?=[\\s.,;]|$)"
    ends = f"\ufffd(?<=[.!?…] ?\ufffd){closes}"
    x.swap((f"{ends}(?<=(?:^|[ {_BREAK}])\ufffd){opens}", _EITHER), (ends, _END), has="\ufffd")
    pair = f"[\ufffd{_EITHER}](?<=(?:^|[ ])[\ufffd{_EITHER}])( ?[\\p{{Lu}}\ufffd][^{_END}{_EITHER}]++){mark}"
    head = lambda t: F.regexp_extract(t, f"^.*{mark}", 0)
    line = lambda t: F.when(t.rlike(mark), F.concat(_swap(head(t), pair, f"{_OPENS[last]}$1{_CLOSES[last]}"), F.substring(t, F.char_length(head(t)) + 1, F.char_length(t)))).otherwise(t)
    lines = F.array_join(F.transform(F.split(F.col(x.column), f"(?<=[{_BREAK}])"), line), "")
    x.apply(F.translate(lines, _END + _EITHER, "\ufffd\ufffd"), has=_END + _EITHER)
    # cut before each opening and after each closing mark; only the parts that open are translated
    cuts = F.split(F.regexp_replace(F.regexp_replace(F.col(x.column), f"([{_OPEN}])", f"{_CUT}$1"), f"([{_CLOSE}])", f"$1{_CUT}"), _CUT)
    quoted = lambda p: p.rlike(f"^[{_OPEN}]") & p.rlike(f"[{_CLOSE}]$")
    thai = F.col(x.column).rlike("[\\u0E00-\\u0E7F]")
    masked = lambda p: F.when(thai, F.translate(p, _TERMS + " ", _MASKED + _HELD)).otherwise(F.translate(p, _TERMS, _MASKED))
    x.apply(F.array_join(F.transform(cuts, lambda p: F.when(quoted(p), masked(p)).otherwise(p)), ""), where=f"[{_OPEN}]")


def _dots(x: _Steps) -> None:
    """Dots of decimals, addresses, initials, abbreviations and list marks, masked.

    Every pattern begins with the dot and looks back from it, so that other characters cost next to nothing;
    addresses and list marks, of any length, are met from their begin.
    """
    letter = "[\\p{L}\\p{M}\\p{N}]"
    # addresses first: their dots may stand before a capital
    begin = "(?:www(?=\\.)|://|@)"
    cuts = F.split(_swap(F.col(x.column), f"{begin}[\\p{{L}}\\p{{M}}\\p{{N}}_.\\-/@:]*+", f"{_CUT}$0{_CUT}"), _CUT)
    x.apply(F.array_join(F.transform(cuts, lambda p: F.when(p.rlike(f"^{begin}"), _swap(p, "\\.(?=[\\p{Ll}\\p{N}])", _DOT)).otherwise(p)), ""), where="www\\.|://|@")
    # figures and versions, a small letter after the dot, acronyms; Thai and Indic abbreviations
    x.swap((f"\\.(?:(?=\\p{{N}})(?<=\\p{{N}}\\.)|(?=\\p{{Ll}})(?<={letter}\\.)|(?=\\p{{Lu}}\\b|-)(?<=(?<![\\p{{L}}\\p{{M}}])\\p{{Lu}}\\.))", _DOT))
    x.swap(("\\.(?:(?<=[\\u0E00-\\u0E7F]\\.)(?=[\\u0E00-\\u0E7F\\p{N}])|(?<=[\\u0900-\\u097F]\\.)(?=[ \\u0900-\\u097F]))", _DOT))
    # abbreviations of several letters with blanks between
    x.swap((f"\\.(?= ?\\p{{L}}{{1,2}}\\.)(?<=(?<!{letter})\\p{{L}}\\.)", _DOT))
    # initials: one capital that no letter stands before, before another name
    x.swap((f"\\.(?= ?\\p{{Lu}})(?<=(?<![\\p{{L}}\\p{{M}}\\p{{N}}{_DOT}])(?<!\\bS[.{_DOT}] ?)(?<!\\be[.{_DOT}] ?)\\p{{Lu}}\\.)", _DOT))
    before = lambda names: f"(?<=(?<!{letter})(?:{names.replace(chr(92) + '.', f'[.{_DOT}]').replace(' ?', '(?: |)')})\\.)"
    gap = "[ \\u00A0]*+"
    x.swap(
        (f"(?iu)\\.(?={gap}[^\\s]){before(NEVER)}", _DOT),
        (f"(?iu)\\.(?={gap}(?:\\p{{N}}|(?-i:\\p{{Ll}}))){before(BEFORE_FIGURE)}", _DOT),
        (f"(?iu)\\.(?={gap}(?:(?-i:\\p{{Ll}})|[,;:])){before(BEFORE_SMALL)}", _DOT),
        (f"\\.(?= (?:{_MONTHS})\\b)(?<=(?<![\\p{{N}}.{_DOT}])\\p{{N}}{{1,2}}\\.)", _DOT),
        # marks of list entries
        (f"(^|[{_BREAK}])([ \\t]*+(?:\\p{{N}}{{1,3}}|\\p{{L}}))\\.(?=[ \\t])", f"$1$2{_DOT}"),
    )


def with_marks(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: the text with terminators masked where they end nothing and the marker after each unit."""
    last, tails = "[)\\]）】’]*", "".join(_TAILS.values())
    x = _Steps(df.withColumn(out, F.col(text)), out)
    x.apply(F.translate(F.col(out), _OWN, _ASIDE), where="[\\uE000-\\uE063]")
    _quotes(x)
    _dots(x)
    # scripts whose terminators need no blank after them
    for t in "。！？｡।॥":
        x.swap((f"{t}[。！？｡।॥]*+(?:[{_CLOSE}][{tails}]*+)?{last}", f"$0{_CUT}"), has=t)
    # a terminator and a blank, before anything but a separator of menus and footers; or the blank left out
    blank = f"(?=[ \\t\\u00A0\\u3000]+[^\\s–—\\-|·•›)\\]{_CLOSE}])"
    glued = f"(?=[\\p{{Lu}}\\p{{Lo}}¿¡{_OPEN}])(?![ºª])"
    for t in ".!?…؟۔":
        run = f"\\Q{t}\\E(?<![.!?…؟۔]\\Q{t}\\E)[.!?…؟۔]*+{last}"
        x.swap((f"{run}{blank}|\\Q{t}\\E(?<=[\\p{{Ll}}\\p{{Lo}}\\p{{M}}\\p{{N}})]\\Q{t}\\E)[.!?…؟۔]*+{last}{glued}", f"$0{_CUT}"), has=t)
    x.swap((f"¦(?<=â€¦)(?:{blank}|{glued})", f"$0{_CUT}"), has="¦")
    x.swap((f";(?<=[\\u0370-\\u03FF];)(?= \\p{{Lu}})", f";{_CUT}"), has=";")
    x.swap((f"\u037e(?= )", f"\u037e{_CUT}"), has="\u037e")
    # after a quotation that ends with a terminator a new sentence begins with a capital; a script without
    # capitals goes on unless a colon led up to the quotation, and so does a text that uses none
    capital = f"(?= *[\\p{{Lu}}\\p{{N}}¿¡{_OPEN}])"
    ended = lambda mark: f"[{mark}](?<=[{_MASKED}][ {_HELD}]?[{mark}])[{tails}]*+"
    plain = "\ue040-\ue04f"
    x.swap((f"{ended(plain)}{capital}", f"$0{_CUT}"), where=f"[{plain}]")
    x.swap((f"{ended(_CLOSE_LED)}(?:{capital}|(?= *\\p{{Lo}}))", f"$0{_CUT}"), where=f"[{_CLOSE_LED}]")
    x.swap((f"{ended(_CLOSE_LED)}(?= +\\p{{Ll}})", f"$0{_CUT}"), where=f"^[^\\p{{Lu}}{_CLOSE_LED}]*+[{_CLOSE_LED}][^\\p{{Lu}}]*+$")
    # Thai: a blank ends a sentence unless it touches a figure, a bracket or a separator; in quotations it is masked
    no = "\\s\\p{N}()\\[\\]（）·|›–—©•*\\-"
    x.swap((f" (?:(?<=[\\u0E00-\\u0E7F] )(?=[^{no}])|(?<=[^{no}] )(?=[\\u0E00-\\u0E7F]))", f" {_CUT}"), where="[\\u0E00-\\u0E7F] | [\\u0E00-\\u0E7F]")
    x.swap((f"\\n[{_BREAK}]*+", f"$0{_CUT}"), has="\n")
    x.swap((f"[\\r\\u0085\\u2028\\u2029\\u000B\\f](?![{_BREAK}{_CUT}])", f"$0{_CUT}"), has="\r\u0085\u2028\u2029\x0b\f")
    return x.df


def _placed(parts: Column, offset: Column, block: int) -> Column:
    """Structs (s, b): blocks of ``block`` parts, each with its begin; a single part if ``block`` is 1."""
    kind = "array<struct<s:int,b:array<string>>>" if block > 1 else "array<struct<s:int,b:string>>"
    zero = F.struct(offset.cast("int").alias("at"), F.array().cast(kind).alias("a"))
    length = (lambda b: F.aggregate(b, F.lit(0), lambda n, p: n + F.char_length(p))) if block > 1 else F.char_length
    step = lambda acc, b: F.struct((acc["at"] + length(b)).cast("int").alias("at"), F.concat(acc["a"], F.array(F.struct(acc["at"].alias("s"), b.alias("b")))).alias("a"))
    if block > 1:
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(parts) / F.lit(block)).cast("int") - 1), lambda i: F.slice(parts, i * block + 1, F.lit(block)))
        return F.when(F.size(parts) <= block, F.array(F.struct(offset.cast("int").alias("s"), parts.alias("b")))).otherwise(F.aggregate(blocks, zero, step, lambda acc: acc["a"]))
    return F.aggregate(parts, zero, step, lambda acc: acc["a"])


def sentences(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", blocks: tuple[int, ...] = (1024, 32)) -> DataFrame:
    """Sentence units: (doc_id, start_pos, end_pos, sentence); positions count code points from 0, the end excluded.

    Units have no blanks at their ends and cover all but blanks; a line break always ends one.  NULL and
    blank texts have no units.  Rows are handled one by one, so repeated documents repeat their units, and
    nothing is shuffled.  Running sums go over blocks of parts within larger blocks, and each unit's text is restored
    from its own part, so a very long text costs in proportion to its length.  Only a text with both characters
    U+E000 to U+E063 and characters U+F0000 to U+F0063 is restored from the whole.  Other columns are dropped.
    """
    aside = F.col("__t").rlike("[\\uE000-\\uE063]")
    x = documents.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__t"))
    x = x.withColumn("__w", F.when(aside & F.col("__t").rlike(f"[{_ASIDE[0]}-{_ASIDE[-1]}]"), F.col("__t"))).withColumn("__o", aside)
    x = with_marks(x, "__t", "__m").select("doc_id", "__w", "__o", F.split(F.col("__m"), _CUT).alias("__b"), F.lit(0).alias("__s"))
    for block in (*blocks, 1):
        x = x.select("doc_id", "__w", "__o", F.explode(_placed(F.col("__b"), F.col("__s"), block)).alias("u")).select("doc_id", "__w", "__o", F.col("u.s").alias("__s"), F.col("u.b").alias("__b"))
    blanks = F.lit(BLANKS)
    left = F.ltrim(F.col("__b"), blanks)
    x = x.select("doc_id", "__w", "__o", (F.col("__s") + F.char_length("__b") - F.char_length(left)).alias("start_pos"), F.rtrim(left, blanks).alias("__u"))
    x = x.select("*", F.char_length("__u").alias("__n")).where("__n > 0")
    own = F.translate("__u", "".join(_RESTORE), "".join(_RESTORE.values()))
    own = F.when(F.col("__w").isNotNull(), F.substring("__w", F.col("start_pos") + 1, F.col("__n"))).when(F.col("__o"), F.translate(own, _ASIDE, _OWN)).otherwise(own)
    return x.select("doc_id", F.col("start_pos").cast("int").alias("start_pos"), (F.col("start_pos") + F.col("__n")).cast("int").alias("end_pos"), own.alias("sentence"))
