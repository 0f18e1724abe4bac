"""Column functions that fold, clean, split and cut text.

All are built-in expressions, so that Catalyst can fuse and push them. Null text is empty
unless a function says otherwise. Regular expressions name their character classes, because
Java's shorthand classes are ASCII only.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that fold to several ASCII letters (fixed values).
MULTI_FOLD = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "TH"}
#: Letters without a canonical decomposition that fold to one (fixed values).
SINGLE_FOLD = {"ı": "i", "ð": "d", "Ð": "D", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L"}
WHITE = r"[ \t\n\x0B\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: All but ``a-z0-9 .,;:!?()%'"-/``, as what it is: Java is eight times as slow with the negated class.
UNCLEAN = r"[\x00-\x1f#$&*+<=>@-`{-\x{10FFFF}]+"
FOREIGN = r"[\u0600-\u06ff\u0750-\u077f\u08a0-\u08ff\u0400-\u052f\u0370-\u03ff\u1f00-\u1fff\u4e00-\u9fff\u3040-\u30ff\uac00-\ud7af\u10a0-\u10ff\u0590-\u05ff]+"


def fold_tables() -> tuple[str, str]:
    """Characters and, place by place, what they fold to; characters beyond are deleted.

    Made from Unicode's canonical decompositions in every script: a letter folds to its base
    letter, and combining marks go. Hangul syllables, whose parts are letters, stay.
    """
    table = dict(SINGLE_FOLD)
    marks = []
    for code in range(0x80, 0x30000):
        c = chr(code)
        if unicodedata.combining(c):
            marks.append(c)
        elif unicodedata.decomposition(c) and c not in table and c not in MULTI_FOLD:
            base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
            if len(base) == 1 and base != c:
                table[c] = base
    marks = "".join(marks)
    return "".join(table) + marks, "".join(table.values())


FOLD_FROM, FOLD_TO = fold_tables()


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, also inside higher-order functions."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WHITE}+|{WHITE}+$", "")


def ascii_fold(c: Column) -> Column:
    """Letters without their accents, in every script; special Latin letters to ASCII; case is kept."""
    many = reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), MULTI_FOLD.items(), _text(c))
    return F.translate(many, FOLD_FROM, FOLD_TO)


def turkish_ascii(c: Column) -> Column:
    """Turkish letters to lower-case ASCII; everything else stays."""
    return F.translate(_text(c), "çğıöşüÇĞİÖŞÜ", "cgiosucgiosu")


def turkish_lower(c: Column) -> Column:
    """Lower case with the Turkish dotted and dotless i."""
    return F.lower(F.translate(_text(c), "İI", "iı"))


def token_clean(c: Column, limit: int | None = None) -> Column:
    """The tokenizer's clean text: Turkish lower case, its alphabet and punctuation, single spaces."""
    t = turkish_lower(F.translate(_text(c), "\u00a0\u200b", " "))
    t = F.regexp_replace(t, rf"{WHITE}+", " ")
    t = F.regexp_replace(t, r"[^a-zçğıöşüâîû0-9 .,;:!?…()%’'\"\-–/]", "")
    t = F.trim(F.regexp_replace(t, " +", " "))
    return F.substring(t, 1, limit) if limit else t


def clean_chars(c: Column, limit: int | None = None, collapse: bool = True) -> Column:
    """Lower-case ASCII letters, digits and common punctuation only.

    Line breaks and tabs are deleted, not made spaces. Without ``collapse`` spaces stay as they are.
    """
    t = F.lower(ascii_fold(F.translate(_text(c), "\u00a0", " ")))
    t = F.regexp_replace(t, UNCLEAN, "")
    t = F.trim(F.regexp_replace(t, " {2,}", " ")) if collapse else t
    return F.substring(t, 1, limit) if limit else t


def clean_response(c: Column, limit: int) -> Column:
    """Without end markers, cleaned, cut at the last sentence end, else the last word end, else empty."""
    t = clean_chars(F.regexp_replace(_text(c), rf"(?i)<{WHITE}*eos{WHITE}*>", " "), collapse=False)
    least = min(15, limit)

    def cut(t: Column) -> Column:
        sentence = F.regexp_extract(F.substring(t, 1, limit), rf"(?s)^(.*[.!?])(?= |$)", 1)
        word = F.regexp_extract(F.substring(t, 1, limit + 1), r"(?s)^(.*) ", 1)
        kept = let(sentence, lambda s: F.when(F.length(s) >= least, s).otherwise(word))
        return F.when(F.length(t) <= limit, t).otherwise(F.rtrim(kept))

    return let(t, cut)


def crawl_clean(c: Column) -> Column:
    """Tags, URLs and runs of blanks to a space, carriage returns too; line feeds stay."""
    t = F.regexp_replace(_text(c), r"<[^>]+>", " ")
    t = F.regexp_replace(t, r"(?i)\bhttps?://[^ \t\n\r\f]+", " ")
    t = F.regexp_replace(t, r"[ \t\xa0]+", " ")
    return _strip(F.replace(t, F.lit("\r"), F.lit(" ")))


#: Entities that are decoded (fixed values); the ampersand comes last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&hellip;": "…", "&ndash;": "–", "&mdash;": "—", "&rsquo;": "’", "&lsquo;": "‘", "&ldquo;": "“", "&rdquo;": "”", "&eacute;": "é", "&ccedil;": "ç", "&ouml;": "ö", "&uuml;": "ü", "&amp;": "&"}


def _numeric_entities(t: Column) -> Column:
    """Decimal and hexadecimal character references as their characters; invalid ones stay."""
    pieces = F.regexp_extract_all(t, F.lit(r"(?s)(&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};|[^&]+|&)"), 1)

    def decoded(p: Column) -> Column:
        number = F.when(p.rlike("^&#[xX]"), F.conv(F.regexp_extract(p, "^&#[xX]([0-9a-fA-F]+);$", 1), 16, 10)).otherwise(F.regexp_extract(p, "^&#([0-9]+);$", 1)).try_cast("int")
        bytes_ = F.when(number < 0x80, F.array(number)).when(number < 0x800, F.array(F.lit(0xC0) + F.shiftright(number, 6), F.lit(0x80) + number % 64))
        bytes_ = bytes_.when(number < 0x10000, F.array(F.lit(0xE0) + F.shiftright(number, 12), F.lit(0x80) + F.shiftright(number, 6) % 64, F.lit(0x80) + number % 64))
        bytes_ = bytes_.otherwise(F.array(F.lit(0xF0) + F.shiftright(number, 18), F.lit(0x80) + F.shiftright(number, 12) % 64, F.lit(0x80) + F.shiftright(number, 6) % 64, F.lit(0x80) + number % 64))
        made = F.decode(F.unhex(F.array_join(F.transform(bytes_, lambda b: F.lpad(F.hex(b), 2, "0")), "")), "UTF-8")
        valid = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        return F.when(p.rlike("^&#.") & valid, made).otherwise(p)

    return F.when(F.contains(t, F.lit("&#")), F.array_join(F.transform(pieces, decoded), "")).otherwise(t)


def html_to_text(c: Column) -> Column:
    """Text of a page: without scripts and styles, tags and short codes, with entities decoded."""
    t = F.regexp_replace(_text(c), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    t = reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), ENTITIES.items(), _numeric_entities(t))
    t = F.regexp_replace(t, r":[a-zA-Z0-9_+\-]+:", " ")
    return _strip(F.regexp_replace(t, rf"{WHITE}{{2,}}", " "))


#: Letters whose capital is several letters, and their capitals of one letter; those without one stay.
LONG_CAPITALS = "".join(chr(code) for code in range(0x80, 0x30000) if len(chr(code).upper()) > 1)
SHORT_CAPITALS = "".join("ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in LONG_CAPITALS)


def simple_upper(c: Column) -> Column:
    """A character's capital of one letter."""
    return F.when((c != "") & F.contains(F.lit(LONG_CAPITALS), c), F.translate(c, LONG_CAPITALS, SHORT_CAPITALS)).otherwise(F.upper(c))


def strip_foreign_scripts(c: Column) -> Column:
    """Runs of non-Latin scripts to a space."""
    return _strip(F.regexp_replace(F.regexp_replace(_text(c), FOREIGN, " "), rf"{WHITE}{{2,}}", " "))


def slug(c: Column) -> Column:
    return F.replace(ascii_fold(F.lower(_strip(_text(c)))), F.lit(" "), F.lit("_"))


def pattern_key(c: Column) -> Column:
    """Folded lower case, single spaces, no sentence marks at the ends."""
    t = F.regexp_replace(F.lower(ascii_fold(F.translate(_text(c), "İ", "I"))), rf"{WHITE}+", " ")
    return F.regexp_replace(t, r"^[?!.,;: ]+|[?!.,;: ]+$", "")


def ascii_letters_only(c: Column) -> Column:
    """Without letters beyond ASCII; null if nothing is left."""
    return F.nullif(_strip(F.regexp_replace(F.regexp_replace(c, r"[\p{L}&&[^\x00-\x7F]]+", ""), rf"{WHITE}{{2,}}", " ")), F.lit(""))


def non_latin_letters(c: Column) -> Column:
    """Sorted distinct letters beyond ASCII."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_text(c), F.lit(r"([\p{L}&&[^\x00-\x7F]])"), 1)))


def printable(c: Column, limit: int = 300) -> Column:
    """Printable characters, single spaces, cut, stripped."""
    t = F.regexp_replace(_text(c), r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}]", "")
    return _strip(F.substring(F.regexp_replace(t, rf"{WHITE}+", " "), 1, limit))


def decode_spacing(c: Column) -> Column:
    """No space before a mark, one behind it if a letter or digit follows, first letter capital."""
    t = F.regexp_replace(_text(c), r" +([,.;:!?…])", "$1")
    t = _strip(F.regexp_replace(t, r"([,.;:!?…])(?=[\p{L}\p{N}])", "$1 "))
    return let(t, lambda x: F.concat(simple_upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x))))


# --- cutting and splitting -------------------------------------------------------------------


def cut_at_word(c: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut at the last space if that keeps three fifths of them."""
    head = F.substring(c, 1, limit)
    space = F.length(head) - F.length(F.substring_index(head, " ", -1)) - 1  # place of the last space, from 0
    cut = F.when((F.instr(head, " ") > 0) & (space >= limit * 0.6), F.trim(F.substring(head, F.lit(1), space))).otherwise(head)
    return F.when(F.length(c) <= limit, c).otherwise(cut)


def refine_response(c: Column, limit: int) -> Column:
    """Cut a long answer at its last sentence end within the limit, else at a word; null if under 10."""
    t = _strip(_text(c))
    head = F.substring(t, 1, limit)
    ended = F.regexp_extract(head, r"(?s)^(.{15,}[.?:!])", 1)
    cut = F.when(ended != "", F.trim(ended)).otherwise(cut_at_word(t, limit))
    out = F.when(F.length(t) <= limit, t).otherwise(cut)
    return F.when((F.length(t) >= 10) & (out != ""), out)


def seq_refine_response(c: Column, limit: int) -> Column:
    """Like ``refine_response`` with 8 characters more room, a hard cut, and a closing full stop."""

    def cut(t: Column) -> Column:
        ended = F.regexp_extract(F.substring(t, 1, limit + 8), r"(?s)^(.{15,}[.?:!])", 1)
        out = F.when(F.length(t) <= limit, t).otherwise(let(ended, lambda e: F.when(e != "", F.trim(e)).otherwise(F.trim(F.substring(t, 1, limit)))))
        return F.when(F.length(t) >= 10, let(out, lambda o: F.when(o.rlike(r"[.?!]$"), o).otherwise(F.concat(o, F.lit(".")))))

    return let(_strip(_text(c)), cut)


def snippet(c: Column, limit: int) -> Column:
    """Whole sentences up to the limit if they pass half of it, else whole words and dots."""
    t = _strip(_text(c))
    head = F.substring(t, 1, limit)
    ended = F.regexp_extract(head, r"(?s)^(.*[.!?])[ \n]", 1)
    word = F.regexp_extract(head, r"(?s)^(.*) ", 1)
    return F.when(F.length(t) <= limit, t).when(F.length(ended) > limit / 2, ended).otherwise(F.concat(F.when(word != "", word).otherwise(head), F.lit("...")))


def short_answer(c: Column, soft: int = 150, hard: int = 120) -> Column:
    """The first sentence within ``soft`` characters, else within ``hard`` more, else cut with dots."""
    t = _strip(F.regexp_replace(_text(c), r"(?i)\([^)]*telaffuz[^)]*\)", ""))
    first = F.regexp_extract(F.substring(t, 1, soft + hard), r"(?s)^(.*?[.!?])(?= |\z)", 1)
    return F.when(F.length(t) <= soft, t).when(first != "", first).otherwise(F.concat(F.rtrim(F.substring(t, 1, soft)), F.lit("...")))


def sentences(c: Column) -> Column:
    """Split behind sentence marks that white space follows, white space collapsed first."""
    t = _strip(F.regexp_replace(_text(c), rf"{WHITE}+", " "))
    return F.filter(F.split(t, r"(?<=[.!?]) +"), lambda s: s != "")


def usable_sentences(c: Column, low: int = 25, high: int = 250) -> Column:
    """Sentences of more than ``low`` and fewer than ``high`` characters without links."""
    return F.filter(sentences(c), lambda s: (F.length(s) > low) & (F.length(s) < high) & ~s.rlike(r"(?i)http|www"))


def plain_sentences(c: Column) -> Column:
    """Parts between runs of sentence marks; a point between digits splits nothing."""
    t = F.regexp_replace(_text(c), r"(\p{Nd})\.(\p{Nd})", "$1\uff0e$2")
    parts = F.transform(F.split(t, rf"[.!?…]+{WHITE}*"), lambda s: _strip(F.replace(s, F.lit("\uff0e"), F.lit("."))))
    return F.filter(parts, lambda s: s != "")


def marked_sentences(c: Column) -> Column:
    """Parts behind sentence marks that white space follows, with their marks."""
    return F.filter(F.split(_strip(_text(c)), rf"(?<=[.!?]){WHITE}+"), lambda s: s != "")


def joined_sentences(parts: Column) -> Column:
    """Sentences joined again; each ends in a full stop whatever its mark was."""
    return F.array_join(F.transform(F.filter(parts, lambda s: s != ""), lambda s: F.concat(F.regexp_replace(s, r"[.!?]+$", ""), F.lit("."))), " ")


def clauses(c: Column) -> Column:
    """Parts between commas and semicolons."""
    return F.filter(F.transform(F.split(_text(c), r"[,;]"), _strip), lambda s: s != "")


#: Conjunctions at which a message is split into segments (fixed values).
CONJUNCTIONS = ("ve", "veya", "ya da", "yoksa", "ama", "fakat", "ancak", "lakin", "sonra", "ardindan", "bundan sonra")


def segments(c: Column) -> Column:
    """Parts between marks and conjunctions; the text itself if there are none."""
    parts = F.split(_text(c), rf"(?i)[.,!?;:•]{WHITE}*|\b(?:{'|'.join(CONJUNCTIONS)})\b")
    return let(F.filter(F.transform(parts, _strip), lambda s: s != ""), lambda kept: F.when(F.size(kept) > 0, kept).otherwise(F.array(_text(c))))


def paragraphs(c: Column, low: int = 40, high: int = 1200, gap: str = r"\n[ \t\f\r]*\n[ \t\n\f\r]*") -> Column:
    """Paragraphs of at least ``low`` characters; longer ones than ``high`` as packs of sentences.

    A pack closes with a sentence of at least ``low`` characters once 300 are used or 900 joined.
    """
    parts = F.transform(F.split(crawl_clean(c), gap), lambda p: _strip(F.regexp_replace(p, r"[ \t]+", " ")))
    parts = F.filter(parts, lambda p: F.length(p) >= low)
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("pack"), F.lit(0).alias("used"))

    def add(acc: Column, s: Column) -> Column:
        pack = F.when(acc["used"] == 0, s).otherwise(F.concat_ws(" ", acc["pack"], s))
        used = acc["used"] + F.length(s) + 1
        close = (F.length(s) >= low) & ((used >= 300) | (F.length(pack) > 900))
        done = F.when(close, F.concat(acc["done"], F.array(F.substring(pack, 1, high)))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(close, "").otherwise(pack).alias("pack"), F.when(close, 0).otherwise(used).alias("used"))

    def finish(acc: Column) -> Column:
        return F.when(F.length(acc["pack"]) >= low, F.concat(acc["done"], F.array(F.substring(acc["pack"], 1, high)))).otherwise(acc["done"])

    packed = F.transform(parts, lambda p: F.when(F.length(p) <= high, F.array(p)).otherwise(F.aggregate(F.split(p, r"(?<=[.!?])[ \n]+"), empty, add, finish)))
    return F.flatten(packed)


def verses(c: Column) -> Column:
    """Cleaned lines of more than 12 characters inside poem blocks."""
    blocks = F.regexp_extract_all(_text(c), F.lit(r"(?s)<poem>(.*?)</poem>"), 1)
    lines = F.flatten(F.transform(blocks, lambda b: F.split(b, r"\r\n|\n|\r")))
    return F.filter(F.transform(lines, lambda x: clean_chars(x, 400)), lambda x: F.length(x) > 12)


def prose_sentences(c: Column) -> Column:
    """Sentences with closing quotes; those whose clean text has more than 8 characters."""
    found = F.regexp_extract_all(_text(c), F.lit(r"([^.!?]+[.!?]+[\"'’)]?(?=\s|$)|[^.!?]+$)"), 1)
    return F.filter(F.transform(found, _strip), lambda s: F.length(clean_chars(s)) > 8)


def wiki_paragraphs(c: Column) -> Column:
    """Cleaned lines of more than 30 characters of wiki text without templates and heading marks."""
    t = F.regexp_replace(_text(c), r"(?s)\{\{.*?\}\}", " ")
    t = F.regexp_replace(t, r"(?m)^=+|=+[ \t]*$", " ")
    return F.filter(F.transform(F.split(t, r"\n\s*"), lambda p: clean_chars(p, 2000)), lambda p: F.length(p) > 30)
