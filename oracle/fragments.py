"""DuckDB SQL for the column functions, written separately from the Spark expressions."""

from __future__ import annotations

from sangloc.sources.views import (
    ANSWER_TEXT,
    BUSY_BENEFITS,
    BUSY_TITLE,
    INDEX_DISTRICT,
    INDEX_PROVINCE,
    POSTING_COLUMNS,
    SUPPLIER_ADDRESSES,
)

SPACE = r"[\s\p{Z}]"
SPECIALS = "!#$%^*?&{}|_+=@[]:;<>/()"
SECTIONS = ("description", "requirements", "benefits")


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rx(c: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({c}, {q(pattern)}, {q(to)}, 'g')"


def has(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {q(pattern)})"


def trim_space(c: str) -> str:
    return rx(c, rf"^{SPACE}+|{SPACE}+$")


def squeeze(c: str) -> str:
    return trim_space(rx(c, rf"{SPACE}+", " "))


def html(c: str) -> str:
    tags = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->|<![a-z][^>]*>|<[a-z/][^>]*>"
    t = rx(rx(rx(rx(c, tags, "\x01"), "^\x01+|\x01+$"), "\x01+", "\x02"), "\x02", "\n")
    for name, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("nbsp", " "), ("lt", "<"), ("gt", ">")):
        t = f"replace({t}, '&{name};', {q(char)})"
    return rx(t, "&amp;?", "&")


def tokens(c: str) -> str:
    return f"list_filter(string_split_regex({c}, {q(SPACE + '+')}), lambda x: x <> '')"


def bare_tokens(c: str) -> str:
    edge = q(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")
    return f"list_transform({tokens(f'lower({c})')}, lambda w: regexp_replace(w, {edge}, '', 'g'))"


def sentences(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '[.!?\\n]+'), lambda x: {trim_space('x')} <> '')"


def standardize(c: str) -> str:
    return f"lower({trim_space(rx(c, '[,.;“:”\"' + chr(39) + '!?-]', ' '))})"


def strip_special(c: str) -> str:
    return rx(c, r"[^\\/\p{L}\p{N}_\s\p{Z},.;<>]+")


def strip_phrase(c: str, phrase: str) -> str:
    return f"CASE WHEN regexp_matches({c}, {q('(?i)' + phrase)}) THEN {squeeze(rx(c, '(?i)' + phrase))} ELSE {c} END"


def special_count(c: str) -> str:
    return f"(length({c}) - length(translate({c}, {q(SPECIALS)}, '')))"


def fold(c: str) -> str:
    return f"replace(replace(strip_accents({c}), 'đ', 'd'), 'Đ', 'D')"


def poor_form(c: str) -> str:
    kept = rx(f"lower({c})", r'[@#$%^&*()–,":;{}|<>_=/+-]')
    return (
        f"array_to_string(list_filter(string_split({kept}, ' '), "
        "lambda w: w NOT IN ('và', 'của', 'có', 'các')), ' ')"
    )


# --- addresses -----------------------------------------------------------------------------


def norm_address(c: str) -> str:
    t = f"lower({c})"
    for old, new in (
        ("tỉnh ", ""), ("thành phố ", "t "), ("thị xã ", "x "), ("quận ", "q "), ("huyện ", "h "), ("phường ", "p "),
        ("tx.", "x "), ("tp.", "t "), ("tp", "t "), ("tx", "x "), ("q.", "q "), ("p.", "p "), (".", ","),
    ):
        t = f"replace({t}, '{old}', '{new}')"
    return rx(rx(rx(t, " *[,–-] *", ","), " +", " "), "(^|[, ])q([0-9]{1,2})", r"\1q \2")


def unit_code(c: str) -> str:
    t = f"lower({c})"
    for old, new in (("thành phố ", "t "), ("thị xã ", "x "), ("quận ", "q "), ("huyện ", "h ")):
        t = f"replace({t}, '{old}', '{new}')"
    return rx(t, "^q([0-9]{1,2})$", r"q \1")


def place_suffix(addr: str, province: str, district: str) -> str:
    """Columns in, expression out."""
    prov, dist = f"lower({province})", unit_code(district)
    bare = f"CASE WHEN NOT {has(addr, '(^|[, ])[qxh] ')} AND length({dist}) > 3 THEN substr({dist}, 3) ELSE '' END"

    def after(prefix: str, name: str) -> str:
        return f"CASE WHEN ({name}) = '' THEN '' ELSE '{prefix}' || ({name}) END"

    listed = addr
    for part in (after(",t ", prov), after(",", prov)):
        listed = f"list_reduce([{listed}, {part}], lambda a, b: CASE WHEN b = '' THEN a ELSE replace(a, b, '') END)"
    for part in ("',t hcm'", "',t hn'"):
        listed = f"replace({listed}, {part}, '')"
    for part in (after(",", dist), after(",", bare)):
        listed = f"list_reduce([{listed}, {part}], lambda a, b: CASE WHEN b = '' THEN a ELSE replace(a, b, '') END)"
    listed = f"replace({listed}, ',việt nam', '')"
    plain = addr
    for part in (after("t ", prov), prov, dist, bare):
        plain = f"list_reduce([{plain}, {part}], lambda a, b: CASE WHEN b = '' THEN a ELSE replace(a, b, '') END)"
    plain = f"replace({plain}, 'việt nam', '')"
    known = f"NOT (contains({prov}, ',') AND contains({dist}, ',')) AND ({prov} <> '' OR {dist} <> '')"
    return f"CASE WHEN NOT ({known}) THEN {addr} WHEN contains({addr}, ',') THEN {listed} ELSE {plain} END"


# --- money ---------------------------------------------------------------------------------

GROUPED = "[0-9]{1,3}(?:[.,][0-9]{3}){2}"
SHORT = "[0-9]{1,2}[.,][0-9]{1,3}|[0-9]{1,5}"
UNIT = "triệu|trieu|tr|m|usd|k/giờ|k/h|k/ngày"
RANGE = (
    f"({GROUPED})(?:vnđ|vnd|đ|d)?(?:-|đến)(?:vnd)?({GROUPED})(?:vnđ|vnd|đ|d)?"
    f"|({SHORT})({UNIT}|k)?(?:-|đến)(?:vnd)?({SHORT})({UNIT})|({SHORT})({UNIT})(?:-|đến)(?:vnd)?({SHORT})"
)
SINGLE = f"({GROUPED})|({SHORT})(triệu|trieu|tr|m|usd|k/giờ|k/h|k/ngày)([0-9]{{1,3}})?"


def noise(c: str) -> str:
    core = "trim(translate(w, '().,:', '     '))"
    return (
        f"array_to_string(list_filter({tokens(c)}, lambda w: NOT (contains(w, 'tr') OR contains(w, 'm')) "
        f"OR regexp_matches(w, '[0-9]') OR {core} IN ('m', 'tr', 'triệu', 'triệu/tháng', 'tr/tháng', 'tr/', 'triệu/')), ' ')"
    )


def squash(c: str) -> str:
    return rx(rx(f"lower(replace({c}, '$', 'usd'))", f"{SPACE}+"), "->|[–~]", "-")


def money_text(c: str) -> str:
    return rx(squash(noise(f"lower({c})")), "[0-9]{9,}", " ")


def _amount(text: str, unit: str) -> str:
    plain = f"regexp_replace({text}, '[.,]', '', 'g')"
    return (
        f"CAST(CASE WHEN {unit} IN ('triệu', 'trieu', 'tr', 'm') "
        f"THEN TRY_CAST(replace({text}, ',', '.') AS DECIMAL(18,3)) * 1000000 "
        f"WHEN {unit} LIKE 'k%' THEN TRY_CAST({plain} AS DECIMAL(18,3)) * 1000 "
        f"ELSE TRY_CAST({plain} AS DECIMAL(18,3)) END AS DECIMAL(18,2))"
    )


def amount_rows(texts: str) -> str:
    """`texts(id, section, t)` -> CTE body `(id, section, kind, unit, low, high)`."""

    def g(i: int) -> str:
        return f"regexp_extract(m, {q(RANGE)}, {i})"

    def s(i: int) -> str:
        return f"regexp_extract(m, {q(SINGLE)}, {i})"

    unit_name = "CASE u WHEN 'usd' THEN 'usd' WHEN 'k/h' THEN 'vnd/hour' WHEN 'k/giờ' THEN 'vnd/hour' WHEN 'k/ngày' THEN 'vnd/day' ELSE 'vnd' END"
    return f"""
    SELECT id, section, 'range' AS kind, {unit_name} AS unit, {_amount('a', 'ua')} AS low, {_amount('b', 'u')} AS high
    FROM (SELECT *, CASE WHEN g1 <> '' THEN g1 WHEN g5 <> '' THEN g3 ELSE g7 END AS a,
                 CASE WHEN g1 <> '' THEN g2 WHEN g5 <> '' THEN g5 ELSE g9 END AS b,
                 CASE WHEN g1 <> '' THEN '' WHEN g5 <> '' THEN g6 ELSE g8 END AS u,
                 CASE WHEN g5 <> '' AND g4 <> '' THEN g4 WHEN g1 <> '' THEN '' WHEN g5 <> '' THEN g6 ELSE g8 END AS ua
          FROM (SELECT id, section, {', '.join(f'{g(i)} AS g{i}' for i in range(1, 10))}
                FROM (SELECT id, section, unnest(regexp_extract_all(t, {q(RANGE)})) AS m FROM {texts})))
    UNION ALL
    SELECT id, section, 'single', {unit_name}, v, v
    FROM (SELECT id, section, s3 AS u,
            CASE WHEN s1 <> '' THEN {_amount('s1', "''")}
                 WHEN s4 <> '' THEN {_amount("regexp_replace(s2, '[.,]', '', 'g') || '.' || s4", 's3')}
                 ELSE {_amount('s2', 's3')} END AS v
          FROM (SELECT id, section, {', '.join(f'{s(i)} AS s{i}' for i in range(1, 5))}
                FROM (SELECT id, section, unnest(regexp_extract_all(regexp_replace(t, {q(RANGE)}, ' ', 'g'), {q(SINGLE)})) AS m
                      FROM {texts}) WHERE NOT regexp_matches(m, '^[01]([.,][0-9]+)?m')))"""


# --- views ---------------------------------------------------------------------------------


def _words(a: int, b: int) -> str:
    return f"array_to_string(string_split_regex(d.text, {q(SPACE + '+')})[{a}:{b}], ' ')"


_BASE = (
    "SELECT "
    + POSTING_COLUMNS.format(TITLE=_words(1, 12), REQ=_words(13, 52), BEN=_words(53, 92))
    + " FROM documents d JOIN nation n ON n.n_nationkey = d.doc_id % 25"
)
POSTINGS = f"postings AS ({_BASE})"
BUSY = (
    f"p AS (SELECT * REPLACE ({BUSY_TITLE} AS title, {BUSY_BENEFITS} AS benefits) FROM ({_BASE})), "
    f"t AS (SELECT *, {', '.join(f'{html(s)} AS {s}_text' for s in SECTIONS)} FROM p)"
)
BUSY_INDEX = BUSY.removesuffix(" FROM p)") + f", {INDEX_PROVINCE} AS place_province, {INDEX_DISTRICT} AS place_district FROM p)"
SUPPLIER = "a AS (" + SUPPLIER_ADDRESSES.format(s="supplier", n="nation", r="region") + ")"
ANSWERS = f"answers AS (SELECT conv_id, turn, {ANSWER_TEXT} FROM conversations)"

ALIASES = (
    "aliases AS (SELECT unnest([lower(n_name), 't ' || lower(n_name)]) AS alias, n_name AS province, "
    "n_nationkey + 1 AS province_id FROM nation)"
)
PLACES = (
    "places AS (SELECT DISTINCT 'quận ' || i AS words, 'district' AS kind FROM range(1, 13) r(i) "
    "UNION SELECT lower(n_name), 'province' FROM nation UNION SELECT lower(r_name), 'province' FROM region "
    "UNION SELECT unnest(['nơi làm việc', 'địa điểm làm việc', 'địa chỉ làm việc']), 'workplace')"
)
STOP = (
    f"stop AS (SELECT DISTINCT w FROM (SELECT unnest({bare_tokens('text')}) AS w FROM benchmark) "
    "WHERE length(w) BETWEEN 1 AND 3)"
)
TOPICS = (
    "topics AS (SELECT DISTINCT w[i] AS term, w[i + 1] AS related FROM "
    f"(SELECT {bare_tokens('text')} AS w FROM benchmark) b, LATERAL (SELECT unnest(range(1, len(w))) AS i) "
    "WHERE length(w[i]) >= 6 AND length(w[i + 1]) >= 1)"
)


def greedy(words: str, lexicon: str, max_words: int, prefix: str = "g") -> str:
    """CTEs `<prefix>_walk(id, pos, n, words, kind)`: leftmost-longest matches of a token list.

    `words(id, w)` holds token lists, `lexicon(words, kind)` the phrases.
    """
    g = prefix
    leads = ", ".join(f"lead(t1, {i}) OVER (PARTITION BY id ORDER BY pos) AS t{i + 1}" for i in range(1, max_words))
    grams = " UNION ALL ".join(
        f"SELECT id, pos, {n} AS n, {' || chr(32) || '.join(f't{i}' for i in range(1, n + 1))} AS words FROM {g}_lead WHERE t{n} IS NOT NULL"
        for n in range(1, max_words + 1)
    )
    return f"""
    {g}_tok AS (SELECT id, unnest(w) AS t1, unnest(range(1, len(w) + 1)) AS pos FROM {words}),
    {g}_lead AS MATERIALIZED (SELECT id, pos, t1, {leads} FROM {g}_tok),
    {g}_hit AS MATERIALIZED (SELECT id, pos, n, x.words, min(kind) AS kind FROM ({grams}) x
        JOIN {lexicon} l ON l.words = x.words GROUP BY ALL),
    {g}_best AS MATERIALIZED (SELECT id, pos, max(n) AS n, max_by(words, n) AS words, max_by(kind, n) AS kind FROM {g}_hit GROUP BY id, pos),
    {g}_next AS MATERIALIZED (SELECT b.*, c.pos AS next FROM {g}_best b ASOF LEFT JOIN {g}_best c ON b.id = c.id AND b.pos + b.n <= c.pos),
    {g}_walk AS (
        SELECT id, min(pos) AS pos, min_by(n, pos) AS n, min_by(words, pos) AS words, min_by(kind, pos) AS kind,
               min_by(next, pos) AS next FROM {g}_next GROUP BY id
        UNION ALL
        SELECT x.id, x.pos, x.n, x.words, x.kind, x.next FROM {g}_walk k JOIN {g}_next x ON x.id = k.id AND x.pos = k.next)"""
