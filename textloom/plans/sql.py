"""SQL pieces for the DuckDB side of the registered queries."""

from __future__ import annotations

from functools import reduce

from textloom.functions.text import FOLD_FROM, FOLD_TO, MULTI_FOLD
from textloom.functions.tokens import STOPWORDS, SUFFIXES


def text(c: str) -> str:
    return f"coalesce({c}, '')"


def fold(c: str) -> str:
    many = reduce(lambda x, kv: f"replace({x}, '{kv[0]}', '{kv[1]}')", MULTI_FOLD.items(), text(c))
    return f"translate({many}, '{FOLD_FROM}', '{FOLD_TO}')"


def clean(c: str) -> str:
    kept = f"regexp_replace(lower({fold(f'replace({c}, chr(160), chr(32))')}), '[^a-z0-9 .,;:!?()%''\"\\-/]', '', 'g')"
    return f"trim(regexp_replace({kept}, ' +', ' ', 'g'))"


def cut(c: str, n: int) -> str:
    head = f"substring({c}, 1, {n})"
    space = f"(length({head}) - length(list_last(string_split({head}, ' '))) - 1)"
    return f"CASE WHEN length({c}) <= {n} THEN {c} WHEN contains({head}, ' ') AND {space} >= {n * 0.6} THEN trim(substring({head}, 1, {space})) ELSE {head} END"


def words(items: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in items) + "]"


def ascii_tokens(c: str) -> str:
    return f"regexp_extract_all(lower({fold(c)}), '[a-z0-9]+')"


def eval_tokens(c: str) -> str:
    return f"regexp_extract_all(lower({text(c)}), '[a-zçğıöşü0-9]+')"


def stop_share(c: str, stop: list[str]) -> str:
    found = f"regexp_extract_all(lower({text(c)}), '[a-zçğıöşü]+')"
    return f"CASE WHEN len({found}) > 0 THEN len(list_filter({found}, lambda w: list_contains({words(stop)}, w))) / len({found}) ELSE 0 END"


def latin_share(c: str) -> str:
    n = f"len(regexp_extract_all({text(c)}, '\\p{{L}}'))"
    return f"CASE WHEN {n} > 0 THEN len(regexp_extract_all({text(c)}, '[A-Za-zçÇğĞıİöÖşŞüÜ]')) / {n} ELSE 0 END"


def sentences(c: str) -> str:
    """Split behind a sentence mark with a space; no look-behind, so marks are doubled first."""
    flat = f"trim(regexp_replace({text(c)}, '\\s+', ' ', 'g'))"
    return f"list_filter(string_split(regexp_replace({flat}, '([.!?]) +', '\\1' || chr(30), 'g'), chr(30)), lambda s: s <> '')"


RAW_PAIRS = """
    valid AS (SELECT conv_id AS conv, turn, CASE WHEN lower(role) = 'user' THEN 'q' WHEN lower(role) = 'assistant' THEN 'a' END AS kind, trim(coalesce(text, '')) AS body
              FROM conversations WHERE lower(role) IN ('user', 'assistant') AND trim(coalesce(text, '')) <> ''),
    lagged AS (SELECT conv, turn, kind, body AS resp, lag(kind) OVER w AS before, lag(body) OVER w AS ctx FROM valid WINDOW w AS (PARTITION BY conv ORDER BY turn)),
    pairs AS (SELECT conv, turn, ctx, resp FROM lagged WHERE kind = 'a' AND before = 'q')"""


SPACES = r"[ \t\n\x0B\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

FOREIGN = r"[\x{0600}-\x{06ff}\x{0750}-\x{077f}\x{08a0}-\x{08ff}\x{0400}-\x{052f}\x{0370}-\x{03ff}\x{1f00}-\x{1fff}\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}\x{10a0}-\x{10ff}\x{0590}-\x{05ff}]+"


def uncollapsed(c: str) -> str:
    return f"regexp_replace(lower({fold(f'replace({c}, chr(160), chr(32))')}), '[^a-z0-9 .,;:!?()%''\"\\-/]', '', 'g')"


def response(c: str, n: int) -> str:
    """Without end markers, cleaned, cut at the last sentence end, else the last word end."""
    t = uncollapsed(f"regexp_replace({c}, '(?i)<\\s*eos\\s*>', ' ', 'g')")
    sentence = f"regexp_extract(substring({t}, 1, {n}), '(?s)^(.*[.!?])(?: |$)', 1)"
    return f"CASE WHEN length({t}) <= {n} THEN {t} ELSE rtrim(CASE WHEN length({sentence}) >= {min(15, n)} THEN {sentence} ELSE regexp_extract(substring({t}, 1, {n + 1}), '(?s)^(.*) ', 1) END) END"


def plain_words(c: str) -> str:
    flat = f"regexp_replace({fold(f'lower({text(c)})')}, '[!-/:-@\\[-`{{-~]', '', 'g')"
    return f"list_filter(regexp_split_to_array({flat}, '{SPACES}+'), lambda w: w <> '')"


def stems(words: str) -> str:
    """CTE ``stems(word, stem)`` of a table of words: the first fitting suffix goes, again and again."""
    cut = lambda x: f"list_filter({words_(SUFFIXES)}, lambda s: length({x}) - length(s) >= 3 AND suffix({x}, s) AND NOT (contains({x}, 'miy') AND starts_with(s, 'mi')))[1]"
    return f"""
    stem_steps AS (
        SELECT word, word AS cur, {cut('word')} AS cut FROM (SELECT DISTINCT word FROM {words})
        UNION ALL SELECT word, cur, {cut('cur')} FROM (SELECT word, left(cur, length(cur) - length(cut)) AS cur FROM stem_steps WHERE cut IS NOT NULL)),
    stems AS (SELECT word, CASE WHEN length(cur) >= 4 THEN left(cur, length(cur) - 1) || translate(right(cur, 1), 'gbd', 'kpt') ELSE cur END AS stem FROM stem_steps WHERE cut IS NULL)"""


words_ = words


def tokens(stop: list[str] = STOPWORDS, search: bool = True, **sources: str) -> str:
    """CTEs ``name_toks(id, ts)`` with stems and bigrams of each source, a query of ``id, text``."""
    keep = words_(list(dict.fromkeys(stop)))
    good = lambda x: f"length({x}) >= 4 AND NOT list_contains({keep}, {x})"
    raw = ", ".join(f"{n}_words AS MATERIALIZED (SELECT id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT id, {plain_words('text')} AS ws FROM ({q})))" for n, q in sources.items())
    every = "all_words AS (" + " UNION ALL ".join(f"SELECT word FROM {n}_words" for n in sources) + ")"
    joined = f"list_concat(ss, list_transform(list_filter(range(1, len(ss)), lambda i: {good('ss[i]')} AND {good('ss[i + 1]')}), lambda i: ss[i] || '_' || ss[i + 1]))"
    joined = f"list_filter({joined}, lambda w: NOT list_contains({keep}, w))" if search else joined
    toks = ", ".join(f"{n}_toks AS MATERIALIZED (SELECT id, {joined} AS ts FROM (SELECT id, list(stem ORDER BY pos) AS ss FROM {n}_words JOIN stems USING (word) GROUP BY id))" for n in sources)
    return f"{raw}, {every}, {stems('all_words')}, {toks}"
