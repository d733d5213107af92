"""DuckDB SQL for every query of the catalog, by the same names."""

from __future__ import annotations

from oracle import fragments as f
from oracle.fragments import q
from sangloc.operators import content_rules, pay_rules, place_rules, rewrite, title_rules
from sangloc.operators.company_rules import MSG_COMPANY_UNCLEAR, MSG_FULL_TIME_ONLY, MSG_NO_COMPANY
from sangloc.operators.verdict import RULES_OF_LABEL, STATUS_TEXT

ORACLE: dict[str, str] = {}

SECTIONS = f.SECTIONS


def docs(**columns: str) -> str:
    return "SELECT doc_id, " + ", ".join(f"{sql} AS {name}" for name, sql in columns.items()) + " FROM documents"


# --- sources and sinks -------------------------------------------------------------------

ORACLE["read_postings"] = f"""
WITH {f.POSTINGS} SELECT CAST(post_id AS VARCHAR) AS post_id, title, company, city_codes, province, district, address,
  employment, money_str, CAST(length(description) AS INTEGER) AS n_description, source || '|' || employment AS keywords
FROM postings"""
ORACLE["quarantine"] = f"""
WITH {f.POSTINGS} SELECT post_id AS request_id, length(description) >= 200 AS has_posting,
  CASE WHEN length(description) < 200 THEN -1 END AS num_error, CASE WHEN length(description) < 200 THEN 0 END AS status,
  CASE WHEN length(description) < 200 THEN 'công ty không tồn tại' END AS message FROM postings"""
ORACLE["read_lexicon"] = "SELECT n_name AS word FROM nation UNION SELECT r_name FROM region"
ORACLE["lexicon_from_map"] = """
SELECT DISTINCT r_name, unnest([n_name, s_name]) AS name
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey"""

# --- cleaning and repair -----------------------------------------------------------------

ORACLE["html_to_text"] = f"SELECT page_id, {f.html('html')} AS text FROM pages"
ORACLE["compose_unicode"] = (
    "SELECT doc_id, nfc_normalize(replace(replace(text, chr(233), 'e' || chr(769)), chr(224), 'a' || chr(768))) AS text "
    "FROM documents"
)
ORACLE["fold_accents"] = docs(text=f.fold("text"))
ORACLE["strip_phrase"] = docs(text=f.strip_phrase("text", "of the"))
ORACLE["strip_special"] = docs(text=f.strip_special("text"))
ORACLE["standardize_text"] = docs(text=f.standardize("text"))
ORACLE["wrap_html"] = docs(html="'<p>' || replace(text, chr(10), '<br />') || '</p>'")
ORACLE["tokens"] = docs(
    n_tokens=f"CAST(len({f.tokens('text')}) AS INTEGER)", tokens=f"array_to_string({f.tokens('text')}, '|')"
)
ORACLE["sentences"] = docs(
    n_sentences=f"CAST(len({f.sentences('text')}) AS INTEGER)", sentences=f"array_to_string({f.sentences('text')}, '|')"
)
ORACLE["normalize_address"] = f"WITH {f.SUPPLIER} SELECT s_suppkey, {f.norm_address('address')} AS address FROM a"
ORACLE["strip_place_suffix"] = f"""
WITH {f.SUPPLIER} SELECT s_suppkey, {f.place_suffix('x', 'province', 'district')} AS detail
FROM (SELECT *, {f.norm_address('address')} AS x FROM a)"""

# R10 and its repair: specials removed kind by kind through a list of running counts
RATIO = f"""
joined AS (SELECT *, description_text || requirements_text || benefits_text AS j FROM t),
kinds AS (SELECT *, {f.special_count('j')} AS n_special, length(j) AS n_chars,
    list_transform(range(0, {len(f.SPECIALS)} + 1), lambda k:
      length(j) - length(translate(j, substr({q(f.SPECIALS)}, 1, k), ''))) AS gone FROM joined),
dropped AS (SELECT *, CASE WHEN n_chars = 0 OR CAST(n_special AS DOUBLE) / n_chars < 0.05 THEN 0 ELSE coalesce(
    list_min(list_filter(range(0, {len(f.SPECIALS)} + 1), lambda k: n_chars - gone[k + 1] = 0
      OR CAST(n_special - gone[k + 1] AS DOUBLE) / (n_chars - gone[k + 1]) < 0.05)), {len(f.SPECIALS)}) END AS k FROM kinds),
fixed AS (SELECT * EXCLUDE (j, n_special, n_chars, gone, k), n_special AS specials, n_chars AS chars,
    {', '.join(f"translate({s}_text, substr({q(f.SPECIALS)}, 1, CAST(k AS BIGINT)), '') AS {s}_fixed" for s in SECTIONS)} FROM dropped)"""
ORACLE["trim_specials_until"] = f"""
WITH {f.BUSY}, {RATIO} SELECT post_id, description_fixed, requirements_fixed, benefits_fixed FROM fixed"""

LONG = "long AS (" + " UNION ALL ".join(f"SELECT post_id, '{s}' AS section, {s}_text AS text FROM t" for s in SECTIONS) + ")"
ORACLE["drop_noise_words"] = f"WITH {f.BUSY}, {LONG} SELECT post_id, section, {f.noise('lower(text)')} AS text FROM long"
ORACLE["squash_money_text"] = f"WITH {f.BUSY}, {LONG} SELECT post_id, section, {f.squash('text')} AS text FROM long"

# --- lexicons ----------------------------------------------------------------------------

PHRASES = f"""
bench AS (SELECT {f.bare_tokens('text')} AS w FROM benchmark),
phrases AS (SELECT DISTINCT array_to_string(w[i:i + n - 1], ' ') AS words, 'phrase' AS kind
    FROM (SELECT w, unnest(range(1, len(w))) AS i FROM bench) s, range(2, 4) r(n) WHERE i + n - 1 <= len(w))"""
ORACLE["compound_phrases"] = f"""
WITH RECURSIVE {PHRASES}, words AS (SELECT doc_id AS id, {f.bare_tokens('text')} AS w FROM documents),
{f.greedy('words', 'phrases', 3)},
singles AS (SELECT id, unnest(w) AS tok, unnest(range(1, len(w) + 1)) AS pos FROM words),
covered AS (SELECT id, unnest(range(pos, pos + n)) AS pos, pos AS first, words FROM g_walk),
parts AS (SELECT s.id, s.pos, CASE WHEN c.pos IS NULL THEN s.tok ELSE replace(c.words, ' ', '_') END AS tok
    FROM singles s LEFT JOIN covered c ON c.id = s.id AND c.pos = s.pos WHERE c.pos IS NULL OR c.pos = c.first)
SELECT d.id AS doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n_tokens, coalesce(x, '') AS text
FROM words d LEFT JOIN (SELECT id, count(*) AS n, string_agg(tok, ' ' ORDER BY pos) AS x FROM parts GROUP BY id) a ON a.id = d.id"""
ORACLE["remove_stopwords"] = f"""
WITH {f.STOP}, words AS (SELECT doc_id, {f.bare_tokens('text')} AS w FROM documents),
singles AS (SELECT doc_id, unnest(w) AS tok, unnest(range(1, len(w) + 1)) AS pos FROM words),
kept AS (SELECT doc_id, count(*) AS n, string_agg(tok, ' ' ORDER BY pos) AS x FROM singles s
    WHERE NOT EXISTS (SELECT 1 FROM stop WHERE stop.w = s.tok) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n_kept, coalesce(x, '') AS text FROM documents d LEFT JOIN kept USING (doc_id)"""


def mentions(text: str, source: str = "t", prefix: str = "g", lexicon: str = "places") -> str:
    return f"{prefix}_in AS (SELECT post_id AS id, {f.bare_tokens(text)} AS w FROM {source}), " + f.greedy(
        f"{prefix}_in", lexicon, 5, prefix
    )


ORACLE["location_mentions"] = f"""
WITH RECURSIVE {f.BUSY}, {f.PLACES},
{mentions("concat_ws(' ', title, description, requirements, benefits_text, address)")}
SELECT DISTINCT id AS post_id, kind, words FROM g_walk"""

TOPIC_HITS = f"""
title_terms AS (SELECT DISTINCT post_id, unnest({f.bare_tokens('title')}) AS term FROM t),
body_terms AS (SELECT DISTINCT post_id, unnest({f.bare_tokens('BODY')}) AS word FROM t),
topic_hits AS (SELECT t.post_id, CAST(count(DISTINCT b.term) AS INTEGER) AS topic_hits FROM t LEFT JOIN (
    SELECT x.post_id, x.term FROM title_terms x LEFT JOIN topics o ON o.term = x.term
    SEMI JOIN body_terms y ON y.post_id = x.post_id AND y.word = coalesce(o.related, x.term)) b USING (post_id) GROUP BY t.post_id)"""
ORACLE["topic_overlap"] = (
    f"WITH {f.BUSY}, {f.TOPICS}, {TOPIC_HITS.replace('BODY', 'description')} SELECT post_id, topic_hits FROM topic_hits"
)
ORACLE["resolve_province"] = f"""
WITH {f.ALIASES}, c AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN upper(n_name) WHEN 1 THEN 'T ' || lower(n_name)
    ELSE 'near ' || n_name END AS place FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, place, province AS named_province, province_id AS named_province_id
FROM c LEFT JOIN aliases ON alias = lower(place)"""


def in_address(source: str, key: str, addr: str) -> str:
    """CTE `located(id, province)`: province named by the address."""
    return f"""
    loose AS (SELECT {key} AS id, {addr} AS addr, {f.tokens(addr)} AS w FROM {source}),
    runs AS (SELECT id, pos, n, array_to_string(w[pos:pos + n - 1], ' ') AS words
        FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS pos FROM loose WHERE NOT contains(addr, ',')) s, range(1, 6) r(n)
        WHERE pos + n - 1 <= len(w)),
    named AS (SELECT id, string_split(addr, ',')[-1] AS name FROM loose WHERE contains(addr, ',')
        UNION ALL SELECT id, arg_max(words, pos * 10 + n) FROM runs WHERE words IN (SELECT alias FROM aliases) GROUP BY id),
    located AS (SELECT loose.id, province FROM loose LEFT JOIN named ON named.id = loose.id LEFT JOIN aliases ON alias = name)"""


def districts_in(source: str, key: str, addr: str, raw: str, province: str) -> str:
    """CTE `district_hit(id, name)`: districts of the province that the address names."""
    return f"""
    cand AS (SELECT id, unnest(string_split(addr, ',')) AS name FROM loose WHERE contains(addr, ',')
        UNION SELECT id, words FROM runs),
    form AS (SELECT {key} AS id, {province} AS province, regexp_matches(lower({raw}), 'quận|q |q\\.|thành phố|tp|thị xã|tx|huyện')
        OR regexp_matches({addr}, '(^|[, ])[qtxh] ') AS coded FROM {source}),
    district_hit AS (SELECT DISTINCT c.id, c.name FROM cand c JOIN form USING (id) JOIN nation ON n_name = form.province
        JOIN range(1, 13) r(i) ON c.name = 'q ' || i)"""


ORACLE["match_province_in_address"] = f"""
WITH {f.SUPPLIER}, {f.ALIASES}, n AS (SELECT *, {f.norm_address('address')} AS x FROM a), {in_address('n', 's_suppkey', 'x')}
SELECT id AS s_suppkey, province AS address_province FROM located"""
ORACLE["match_district_of_province"] = f"""
WITH {f.SUPPLIER}, {f.ALIASES}, n AS (SELECT *, {f.norm_address('address')} AS x FROM a), {in_address('n', 's_suppkey', 'x')},
{districts_in('n', 's_suppkey', 'x', 'address', 'province')}
SELECT id AS s_suppkey, name AS district FROM district_hit"""

# --- rules: name -> (extra CTEs, source, count, message, extra columns) --------------------

RULE: dict[str, tuple[tuple[str, ...], str, str, str, str]] = {}


def simple(name: str, condition: str, message: str, extra: str = "", ctes: tuple[str, ...] = (), source: str = "t") -> None:
    RULE[name] = (ctes, source, f"CAST(coalesce(({condition}), false) AS INTEGER)", q(message), extra)


BAD = "len(list_filter(string_split(city_codes, ','), lambda x: NOT coalesce(TRY_CAST(trim(x) AS INTEGER) BETWEEN 1 AND 63, false)))"
CODE_COUNT = f"CASE WHEN city_codes IS NULL THEN 1 WHEN a.alias IS NOT NULL OR {BAD} = 0 THEN {BAD} ELSE 1 END"
RULE["province_code"] = (
    (f.ALIASES,),
    "t LEFT JOIN aliases a ON a.alias = lower(trim(t.province))",
    f"CAST({CODE_COUNT} AS INTEGER)",
    f"CASE WHEN city_codes IS NULL THEN '{place_rules.MSG_NO_PROVINCE}' WHEN a.alias IS NULL THEN '{place_rules.MSG_BAD_PROVINCE}' ELSE '' END",
    f", CASE WHEN {CODE_COUNT} > 0 AND a.alias IS NOT NULL THEN CAST(province_id AS VARCHAR) ELSE city_codes END AS city_codes_fixed",
)
NATION_A = "lower(trim(address)) IN ('toàn quốc', 'tuyển dụng toàn quốc')"
NATION_P = "contains(lower(province), 'toàn quốc')"
RULE["nationwide"] = (
    (), "t", f"CAST({NATION_A} OR {NATION_P} AS INTEGER)",
    f"concat_ws(chr(10), CASE WHEN {NATION_A} THEN '{place_rules.MSG_ADDRESS_NATIONWIDE}' END, "
    f"CASE WHEN {NATION_P} THEN '{place_rules.MSG_PROVINCE_NATIONWIDE}' END)", "",
)
DETAIL = f"""
detail AS (SELECT *, {f.place_suffix('x', 'province', 'district')} AS address_detail
    FROM (SELECT *, {f.norm_address(f.strip_phrase('address', '(tuyển dụng )?toàn quốc'))} AS x FROM t)),
detail2 AS (SELECT *, string_split(address_detail, ',') AS s FROM detail)"""
simple(
    "address_detail",
    "NOT regexp_matches(s[1], 'tòa|khu|kcn|cụm|ccn|lô|chung cư|plaza|tầng|lầu|số') AND CASE WHEN len(s) > 1 "
    "THEN NOT regexp_matches(s[1], '[0-9]') AND NOT regexp_matches(s[2], '[0-9]|số') AND len(s) < 4 "
    "ELSE NOT regexp_matches(regexp_replace(s[1], '(phường|quận|p|q)[ .][0-9]{1,2}', ' ', 'g'), '[0-9]') END",
    place_rules.MSG_NO_DETAIL, ", address_detail", (DETAIL,), "detail2",
)
NO_ACCENT = f"(address_detail = '' OR address_detail = {f.fold('address_detail')})"
simple(
    "multi_address",
    f"NOT {NO_ACCENT} AND list_has_any({f.tokens('replace(' + f.rx('address_detail', place_rules.LOCATION_WORDS) + chr(44) + chr(39) + ',' + chr(39) + chr(44) + chr(39) + ' ' + chr(39) + ')')}, ['và', 'hoặc'])",
    place_rules.MSG_MANY_ADDRESSES, "", (DETAIL,), "detail2",
)
simple("address_missing", NO_ACCENT, place_rules.MSG_NO_ADDRESS, "", (DETAIL,), "detail2")
simple(
    "employment_type",
    f.has(f.rx("lower(employment)", r"[^\p{L}\p{N}\s\p{Z}]"), "bán thời gian|việc làm từ xa|parttime|học việc"),
    MSG_FULL_TIME_ONLY,
)
HOUR = "[0-9]{2}k/(h|giờ)"
simple(
    "hourly_wage",
    " OR ".join(f.has(f.squash(c), HOUR) for c in ("description_text", "benefits_text", "money_str")),
    pay_rules.MSG_HOURLY,
)
ALL_TEXT = "replace(concat_ws(' ', description_text, requirements_text, benefits_text), '.', ' ')"
WORKPLACES = f"""{mentions(ALL_TEXT, 't', 'w')},
w_counts AS (SELECT id, count(DISTINCT words) FILTER (kind = 'workplace') AS nw, count(DISTINCT words) FILTER (kind = 'district') AS nd,
    count(DISTINCT words) FILTER (kind = 'province') AS np FROM w_walk GROUP BY id)"""
simple(
    "many_workplaces", "nw > 0 AND (nd > 1 OR np > 1)", pay_rules.MSG_MANY_PLACES, "",
    (f.PLACES, WORKPLACES), "t LEFT JOIN w_counts c ON c.id = t.post_id",
)
AMOUNTS = f"""
money AS ({' UNION ALL '.join(f"SELECT post_id AS id, '{s}' AS section, {f.money_text(f'{s}_text')} AS t FROM t" for s in SECTIONS)}
    UNION ALL SELECT post_id, 'declared', {f.squash('money_str')} FROM t),
amounts AS ({f.amount_rows('money')}),
declared AS (SELECT id, count(*) FILTER (kind = 'range') AS dr, count(*) FILTER (kind = 'single') AS ds
    FROM amounts WHERE section = 'declared' GROUP BY id),
content AS (SELECT id, count(*) AS n, count(*) FILTER (kind = 'range') AS nr, count(*) FILTER (kind = 'single') AS ns
    FROM amounts WHERE section <> 'declared' GROUP BY id),
pay AS (SELECT t.post_id, t.money_str, coalesce(dr, 0) AS dr, coalesce(ds, 0) AS ds, coalesce(n, 0) AS n, coalesce(nr, 0) AS nr,
    coalesce(ns, 0) AS ns FROM t LEFT JOIN declared d ON d.id = t.post_id LEFT JOIN content c ON c.id = t.post_id)"""
simple("negotiable_but_paid", "trim(money_str) = 'Thỏa thuận' AND n > 0", pay_rules.MSG_NEGOTIABLE_PAID, "", (AMOUNTS,), "pay")
simple(
    "salary_absent", "dr > 0 AND n = 0 AND NOT contains(lower(money_str), 'tr')", pay_rules.MSG_NO_PAY, "", (AMOUNTS,), "pay"
)
simple("many_salaries", "n > 1", pay_rules.MSG_MANY_PAYS, "", (AMOUNTS,), "pay")
CONFLICT = """
differing AS (SELECT c.id, c.kind, count(*) AS n_diff FROM (
    SELECT c.id, c.kind, c.section, bool_or(c.unit = d.unit AND c.low = d.low AND c.high = d.high) AS same
    FROM amounts c JOIN (SELECT id, kind, first(unit) AS unit, first(low) AS low, first(high) AS high FROM amounts
        WHERE section = 'declared' GROUP BY id, kind) d ON d.id = c.id AND d.kind = c.kind
    WHERE c.section <> 'declared' GROUP BY c.id, c.kind, c.section) c WHERE NOT same GROUP BY c.id, c.kind),
conflict AS (SELECT p.*, coalesce(x.n_diff, 0) AS diff_r, coalesce(y.n_diff, 0) AS diff_s FROM pay p
    LEFT JOIN differing x ON x.id = p.post_id AND x.kind = 'range' LEFT JOIN differing y ON y.id = p.post_id AND y.kind = 'single')"""
RULE["salary_conflict"] = (
    (AMOUNTS, CONFLICT), "conflict",
    "CAST(CASE WHEN dr > 0 THEN CASE WHEN nr > 0 THEN diff_r ELSE CAST(ns > 0 AS INTEGER) END "
    "WHEN trim(money_str) = 'Thỏa thuận' THEN CAST(n > 0 AS INTEGER) WHEN nr > 0 THEN 1 WHEN ds > 0 THEN diff_s "
    "ELSE CAST(ns > 0 AS INTEGER) END AS INTEGER)",
    q(pay_rules.MSG_PAY_CONFLICT), "",
)
SPELLED = f"replace(replace({f.norm_address('address')}, 'toà', 'tòa'), 'thủy', 'thuỷ')"
DISTRICT = f"""
da AS (SELECT *, regexp_replace({SPELLED}, ',việt nam$', '') AS x, {f.unit_code('district')} AS own FROM t),
{in_address('da', 'post_id', 'x')},
declared_p AS (SELECT post_id, a.province AS dp FROM t LEFT JOIN aliases a ON a.alias = lower(trim(t.province))),
db AS (SELECT da.*, dp, l.province AS ap FROM da JOIN declared_p USING (post_id) JOIN located l ON l.id = da.post_id),
{districts_in('db', 'post_id', 'x', 'address', 'dp')},
others AS (SELECT db.post_id, count(h.name) AS n_other, arg_max(h.name, list_position(string_split(x, ','), h.name)) AS last_named FROM db LEFT JOIN district_hit h ON h.id = db.post_id AND h.name <> db.own GROUP BY ALL),
dc AS (SELECT db.*, n_other, last_named, contains(own, ',') AS many, own = '' OR province = '' AS missing,
    CASE WHEN contains(x, ',') THEN list_contains(string_split(x, ','), own) OR list_contains(string_split(x, ','), substr(own, 3))
      ELSE contains(x, own) OR contains(x, substr(own, 3)) END AS present FROM db JOIN others USING (post_id)),
dd AS (SELECT *, NOT missing AND ap IS NOT NULL AND coalesce(ap = dp, false) AND NOT present AS absent,
    NOT missing AND ap IS NOT NULL AND NOT coalesce(ap = dp, false) AS elsewhere, NOT missing AND ap IS NULL AND dp IS NULL AS unk,
    CASE WHEN NOT missing AND ap IS NULL THEN n_other ELSE 0 END AS other FROM dc)"""
RULE["district_province"] = (
    (f.ALIASES, DISTRICT), "dd",
    "CAST(many::INT + missing::INT + absent::INT + elsewhere::INT + unk::INT + other AS INTEGER)",
    f"concat_ws(chr(10), CASE WHEN many THEN '{place_rules.MSG_MANY_DISTRICTS}' END, CASE WHEN missing THEN '{place_rules.MSG_NO_PLACE}' END, "
    f"CASE WHEN absent THEN '{place_rules.MSG_DISTRICT_ABSENT}' END, CASE WHEN elsewhere THEN '{place_rules.MSG_OTHER_PROVINCE}' END, "
    f"CASE WHEN unk THEN '{place_rules.MSG_UNKNOWN_PROVINCE}' END, CASE WHEN other > 0 THEN '{place_rules.MSG_OTHER_DISTRICT}' END)",
    ", coalesce(CASE WHEN (absent OR other > 0) AND contains(x, ',') THEN 'Quận ' || substr(last_named, 3) END, district) AS district_fixed",
)
# The index profile: places from the posting's own fields, which may list several provinces
OWN_PROVINCE, OWN_DISTRICT = "coalesce(place_province, province, '')", "coalesce(place_district, district, '')"
DISTRICT_INDEX = f"""
da AS (SELECT *, regexp_replace({SPELLED}, ',việt nam$', '') AS x, {f.unit_code(OWN_DISTRICT)} AS own,
    list_filter(list_transform(string_split(lower({OWN_PROVINCE}), ','), lambda n: trim(n)), lambda n: n <> '') AS names FROM t),
{in_address('da', 'post_id', 'x')},
declared_p AS (SELECT DISTINCT post_id, a.province AS dp FROM (SELECT post_id, unnest(names) AS name FROM da) JOIN aliases a ON a.alias = name),
{districts_in('da JOIN declared_p USING (post_id)', 'post_id', 'x', 'address', 'dp')},
others AS (SELECT da.post_id, count(h.name) AS n_other FROM da LEFT JOIN district_hit h ON h.id = da.post_id AND h.name <> da.own GROUP BY ALL),
dc AS (SELECT da.*, n_other, l.province AS ap, (SELECT list(dp) FROM declared_p p WHERE p.post_id = da.post_id) AS dps,
    contains(own, ',') AS many, own = '' OR len(names) = 0 AS missing,
    CASE WHEN contains(x, ',') THEN list_contains(string_split(x, ','), own) OR list_contains(string_split(x, ','), substr(own, 3))
      ELSE contains(x, own) OR contains(x, substr(own, 3)) END AS present
    FROM da JOIN others USING (post_id) JOIN located l ON l.id = da.post_id),
dd AS (SELECT *, NOT missing AND ap IS NOT NULL AND coalesce(list_contains(dps, ap), false) AND NOT present AS absent,
    NOT missing AND ap IS NOT NULL AND NOT coalesce(list_contains(dps, ap), false) AS elsewhere, NOT missing AND ap IS NULL AND dps IS NULL AS unk,
    CASE WHEN NOT missing AND ap IS NULL THEN n_other ELSE 0 END AS other FROM dc)"""
RULE["district_province_index"] = ((f.ALIASES, DISTRICT_INDEX), *RULE["district_province"][1:4], "")
COMPANY = "lower(company)"


def keywords(words: list[str]) -> str:
    return " + ".join(f"CAST(contains({COMPANY}, '{w}') AS INTEGER)" for w in words)


RULE["company_banned_words"] = (
    (), "t", f"{keywords(['tuyển dụng', 'tìm việc làm', 'việc làm'])} + CAST(company = '' AS INTEGER)",
    f"CASE WHEN company = '' THEN '{MSG_NO_COMPANY}' ELSE '' END", "",
)
FORMS = ["công ty cổ phần", "công ty cp", "công ty", "tập đoàn", "trung tâm", "hệ thống", "cty", "group", "tnhh",
         "bất động sản", "shinhan fc", "aliexpress"]
simple("company_form", f"({keywords(FORMS)}) < 2", MSG_COMPANY_UNCLEAR)

PHONES = ["[0-9]{10}", "[0-9]{5} [0-9]{5}", "[0-9]{4} [0-9]{3} [0-9]{3}", "[0-9]{4}-[0-9]{3}-[0-9]{3}", "[0-9]{3}-[0-9]{3}-[0-9]{4}"]
PAY = [
    "[0-9]{7,8}|[0-9] [0-9]{6}|[0-9]{1,2}[ .,][0-9]{3}[ .,][0-9]{3}", "[0-9]{1,2} ?(triệu|tr|m)(/ ?tháng)?",
    "[0-9]{2} ?k( ?/ ?(giờ|h))?", "thu nhập", "part[ -]?time|partime", "lương( cứng)?", "hoa hồng", "thưởng",
]


def hits(c: str, patterns: list[str]) -> str:
    return " + ".join(f"CAST({f.has(c, '(?i)' + p)} AS INTEGER)" for p in patterns)


TOWN = "town AS (SELECT * FROM places WHERE kind <> 'workplace')"


def title_rule(name: str, title: str, source: str) -> None:
    """R9 rule `name` on the column `title` of `source`."""
    if name == "title_phone":
        n = hits(title, PHONES)
        RULE[name] = ((), source, f"CAST({n} AS INTEGER)", q(title_rules.MSG_PHONE),
                      f", CASE WHEN {n} > 0 THEN {f.rx(title, '|'.join(PHONES))} ELSE {title} END AS title_fixed")
    elif name == "title_special":
        simple(name, f"{f.strip_special(title)} <> {title}", title_rules.MSG_SPECIAL,
               f", {f.strip_special(title)} AS title_fixed", (), source)
    elif name == "title_branch":
        simple(name, f"contains(lower({title}), 'chi nhánh')", title_rules.MSG_BRANCH,
               f", {f.strip_phrase(title, 'chi nhánh')} AS title_fixed", (), source)
    elif name == "title_place":
        ctes = f"""{mentions(title, source, 'h', 'town')},
        h_names AS (SELECT id, count(DISTINCT words) AS n, bool_or(kind = 'province') AS np, bool_or(kind = 'district') AS nd FROM h_walk GROUP BY id),
        h_all AS (SELECT post_id AS id, unnest({f.tokens(title)}) AS tok, unnest(range(1, len({f.tokens(title)}) + 1)) AS pos FROM {source}),
        h_cov AS (SELECT id, unnest(range(pos, pos + n)) AS pos FROM h_walk),
        h_left AS (SELECT id, string_agg(tok, ' ' ORDER BY pos) AS rest FROM h_all ANTI JOIN h_cov USING (id, pos) GROUP BY id)"""
        RULE[name] = (
            (f.PLACES, TOWN, ctes), f"{source} LEFT JOIN h_names hn ON hn.id = {source}.post_id LEFT JOIN h_left hl ON hl.id = {source}.post_id",
            "CAST(coalesce(n, 0) AS INTEGER)",
            f"concat_ws(chr(10), CASE WHEN np THEN '{title_rules.MSG_TITLE_PROVINCE}' END, CASE WHEN nd THEN '{title_rules.MSG_TITLE_DISTRICT}' END)",
            f", CASE WHEN n > 0 THEN coalesce(rest, '') ELSE {title} END AS title_fixed",
        )
    elif name == "title_salary":
        ctes, last = [], source
        for i, p in enumerate(PAY):
            prev = title if i == 0 else f"s{i}"
            ctes.append(f"ts{i + 1} AS (SELECT *, {f.rx(prev, '(?i)' + p, ' ')} AS s{i + 1}, CAST({f.has(prev, '(?i)' + p)} AS INTEGER) AS c{i + 1} FROM {last})")
            last = f"ts{i + 1}"
        n = " + ".join(f"c{i + 1}" for i in range(len(PAY)))
        RULE[name] = (tuple(ctes), last, f"CAST({n} AS INTEGER)", q(title_rules.MSG_TITLE_PAY),
                      f", CASE WHEN {n} > 0 THEN {f.squeeze(f's{len(PAY)}')} ELSE {title} END AS title_fixed")


for _name in RULES_OF_LABEL[9]:
    title_rule(_name, "title", "t")
RULE["title_index"] = (
    (f.PLACES, TOWN, mentions('title', 't', 'h', 'town'),
     "h_names AS (SELECT id, count(DISTINCT words) AS n FROM h_walk GROUP BY id)"),
    "t LEFT JOIN h_names hn ON hn.id = t.post_id",
    f"CAST({hits('title', PHONES)} + CAST(regexp_matches(title, {q(r'[!@#$%^&*()?' + chr(34) + r':;{}|<>_=/+]')}) AS INTEGER) "
    f"+ CAST(contains(lower(title), 'chi nhánh') AS INTEGER) + coalesce(n, 0) + {hits('title', [PAY[0], '[0-9]{1,2} ?(triệu|tr|m($|[ ,.;!/)]))'])} AS INTEGER)",
    q(title_rules.MSG_TITLE_INDEX), "",
)
LEFT = " + ".join(f"length({s}_fixed)" for s in SECTIONS)
RATIO_COUNT = f"CASE WHEN chars = 0 OR {LEFT} = 0 THEN 2 WHEN CAST(specials AS DOUBLE) / chars >= 0.05 THEN 1 ELSE 0 END"
RULE["special_ratio"] = (
    (RATIO,), "fixed", RATIO_COUNT,
    f"CASE WHEN {RATIO_COUNT} = 2 THEN '{content_rules.MSG_NO_SECTIONS}' ELSE '{content_rules.MSG_SPECIAL_RATIO}' END", "",
)

# --- similarity --------------------------------------------------------------------------

PAIR_STOP = "('và', 'của', 'có', 'là', 'cho', 'đến')"


def word_terms(c: str) -> str:
    split = r"[^\p{L}\p{N}_]+"
    return f"list_filter(string_split_regex(lower({c}), '{split}'), lambda x: length(x) >= 2 AND x NOT IN {PAIR_STOP})"


def cosines(source: str, title: str, body: str, prefix: str, stop: bool) -> str:
    """CTEs `<prefix>_tfidf(id, tfidf)` and `<prefix>_cos(id, cosine)` of two text columns."""

    def counts(name: str, col: str, words: str, where: str = "") -> str:
        return f"{prefix}_{name} AS (SELECT id, w, count(*) AS n FROM (SELECT post_id AS id, unnest({words.replace('COL', col)}) AS w FROM {source}) {where} GROUP BY id, w)"

    plain = f.tokens(f.standardize("COL"))
    where = "WHERE w NOT IN (SELECT w FROM stop)" if stop else ""
    return f"""
    {counts('ta', title, word_terms('COL'))}, {counts('tb', body, word_terms('COL'))},
    {prefix}_tw AS (SELECT id, w, coalesce(a.n, 0) AS a, coalesce(b.n, 0) AS b,
        CASE WHEN a.n IS NULL OR b.n IS NULL THEN 1 + ln(1.5) ELSE 1 END AS idf FROM {prefix}_ta a FULL JOIN {prefix}_tb b USING (id, w)),
    {prefix}_tfidf AS (SELECT id, sum(a * b * idf * idf) / nullif(sqrt(sum(a * a * idf * idf)) * sqrt(sum(b * b * idf * idf)), 0) AS tfidf
        FROM {prefix}_tw GROUP BY id),
    {counts('ca', title, plain, where)}, {counts('cb', body, plain, where)},
    {prefix}_cos AS (SELECT id, sum(coalesce(a.n, 0) * coalesce(b.n, 0)) / nullif(sqrt(sum(coalesce(a.n * a.n, 0))) * sqrt(sum(coalesce(b.n * b.n, 0))), 0) AS cosine
        FROM {prefix}_ca a FULL JOIN {prefix}_cb b USING (id, w) GROUP BY id)"""


SCORE = "0.75 * coalesce(cosine, 0) + 0.25 * coalesce(tfidf, 0)"
MISMATCH = (f.STOP, cosines("t", "title", "description_text", "m", True))
simple(
    "title_body_mismatch", f"{SCORE} < 0.3", content_rules.MSG_MISMATCH, "", MISMATCH,
    "t LEFT JOIN m_cos c ON c.id = t.post_id LEFT JOIN m_tfidf f ON f.id = t.post_id",
)
simple(
    "topic_mismatch", "topic_hits = 0", content_rules.MSG_TOPIC, "",
    (f.TOPICS, TOPIC_HITS.replace("BODY", "description_text")), "topic_hits",
)

def rule_select(name: str) -> str:
    _, source, count, message, extra = RULE[name]
    return f"SELECT post_id, {count} AS violations, CASE WHEN {count} > 0 THEN {message} ELSE '' END AS message{extra} FROM {source}"


for _name in RULE:
    _posts = f.BUSY_INDEX if _name == "district_province_index" else f.BUSY
    ORACLE[f"rule_{_name}"] = f"WITH RECURSIVE {', '.join((_posts, *RULE[_name][0]))} {rule_select(_name)}"

SIM = f"{f.BUSY}, {cosines('t', 'title', 'description', 'm', False)}"
ORACLE["pair_tfidf_cosine"] = f"WITH {SIM} SELECT post_id, round(tfidf, 6) AS tfidf FROM t LEFT JOIN m_tfidf ON id = post_id"
ORACLE["term_cosine"] = f"WITH {SIM} SELECT post_id, round(cosine, 6) AS cosine FROM t LEFT JOIN m_cos ON id = post_id"
ORACLE["final_score"] = f"""
WITH {SIM} SELECT post_id, round({SCORE}, 6) AS score, round({SCORE}, 6) >= 0.3 AS matches
FROM t LEFT JOIN m_cos c ON c.id = post_id LEFT JOIN m_tfidf f ON f.id = post_id"""


def bm25(docs_cte: str, queries_cte: str, same: str) -> str:
    """CTE `bm25(qid, id, s)` for docs(id, w) and asks(qid, w) lists."""
    return f"""
    dl AS (SELECT id, len(w) AS len, unnest(w) AS term FROM {docs_cte}),
    tf AS (SELECT id, len, term, count(*) AS tf FROM dl GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM {docs_cte}),
    qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest(w) AS term FROM {queries_cte}) GROUP BY ALL),
    bm25 AS (SELECT qid, id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))) AS s
        FROM qt JOIN tf USING (term) JOIN df USING (term), st WHERE {same} GROUP BY qid, id)"""


OWN = f"""
own AS (SELECT post_id AS id, {f.tokens(f.standardize('description'))} AS w FROM t),
heads AS (SELECT post_id AS qid, {f.tokens(f.standardize('title'))} AS w FROM t), {bm25('own', 'heads', 'qid = id')}"""
ORACLE["bm25_score"] = f"""
WITH {f.BUSY}, {OWN} SELECT post_id, round(coalesce(s, 0), 5) AS bm25 FROM t LEFT JOIN bm25 ON id = post_id"""
ORACLE["hybrid_score"] = f"""
WITH {SIM}, {OWN} SELECT post_id, round(0.5 * coalesce(s, 0) + 0.5 * coalesce(cosine, 0), 5) AS hybrid
FROM t LEFT JOIN bm25 b ON b.id = post_id LEFT JOIN m_cos c ON c.id = post_id"""
ORACLE["bm25_top_k"] = f"""
WITH ds AS (SELECT doc_id AS id, {f.bare_tokens('text')} AS w FROM documents),
asks AS (SELECT item_id AS qid, {f.bare_tokens('text')} AS w FROM benchmark), {bm25('ds', 'asks', 'true')}
SELECT qid AS item_id, id AS doc_id, CAST(r AS INTEGER) AS rank, x AS bm25
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY x DESC, id) AS r FROM (SELECT qid, id, round(s, 6) AS x FROM bm25)) WHERE r <= 5"""
COS = (
    "list_sum(list_transform(range(1, len({a}) + 1), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)))"
)


def vec_cos(a: str, b: str) -> str:
    return f"{COS.format(a=a, b=b)} / (sqrt({COS.format(a=a, b=a)}) * sqrt({COS.format(a=b, b=b)}))"


ORACLE["embedding_cosine"] = f"""
SELECT x.vec_id, round({vec_cos('x.embedding', 'y.embedding')}, 6) AS cosine FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1"""
VECTORED = f"""scored AS (SELECT t.post_id, 0.75 * coalesce({vec_cos('x.embedding', 'y.embedding')}, 0) + 0.25 * coalesce(tfidf, 0) AS score
    FROM t LEFT JOIN m_tfidf m ON m.id = t.post_id LEFT JOIN embeddings x ON x.vec_id = t.post_id
    LEFT JOIN embeddings y ON y.vec_id = t.post_id + 1)"""
ORACLE["final_score_vectors"] = f"WITH {SIM}, {VECTORED} SELECT post_id, round(score, 6) AS score FROM scored"
ORACLE["rule_title_body_mismatch_vectors"] = f"""
WITH {f.BUSY}, {f.STOP}, {cosines('t', 'title', 'description_text', 'm', True)}, {VECTORED}
SELECT post_id, CAST(score < 0.3 AS INTEGER) AS violations FROM scored"""


def hashed(side: str, text: str) -> str:
    return f"""h{side} AS (SELECT id, ('0x' || substr(md5(w), 1, 7))::BIGINT % 256 AS place,
        sum(CASE WHEN ('0x' || substr(md5(w), 8, 1))::BIGINT % 2 = 0 THEN 1 ELSE -1 END) AS x
        FROM (SELECT post_id AS id, unnest({f.tokens(f.standardize(text))}) AS w FROM t) GROUP BY ALL)"""


ORACLE["hashed_cosine"] = f"""
WITH {f.BUSY}, {hashed('a', 'title')}, {hashed('b', 'description')},
norms AS (SELECT post_id AS id, (SELECT sum(x * x) FROM ha WHERE ha.id = post_id) AS aa, (SELECT sum(x * x) FROM hb WHERE hb.id = post_id) AS bb FROM t),
dots AS (SELECT ha.id, sum(ha.x * hb.x) AS ab FROM ha JOIN hb USING (id, place) GROUP BY ha.id)
SELECT n.id AS post_id, round(coalesce(ab, 0) / nullif(sqrt(aa) * sqrt(bb), 0), 6) AS cosine FROM norms n LEFT JOIN dots USING (id)"""
ORACLE["adjacent_coherence_vectors"] = f"""
SELECT label, count(c) AS n_pairs, round(avg(c), 6) AS coherence FROM (
  SELECT label, {vec_cos('p', 'embedding')} AS c FROM (
    SELECT label, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings)) GROUP BY label"""

# --- quality metrics ---------------------------------------------------------------------

LOWER = f.tokens("lower(text)")
ORACLE["too_short"] = docs(
    n_words=f"CAST(len({f.tokens('text')}) AS INTEGER)", is_short=f"len({f.tokens('text')}) < 30 OR length(text) < 200"
)


def read_parts(source: str, key: str) -> str:
    """CTE `rd(key, wps, cpw, poly, score)`."""
    words = f.tokens(f.rx("text", "[.!?\\n]+", " "))
    return f"""
    rw AS (SELECT {key}, {words} AS w, len({f.sentences('text')}) AS ns FROM {source}),
    rp AS (SELECT {key}, len(w) AS nw, len(w)::DOUBLE / nullif(ns, 0) AS wps, length(array_to_string(w, ''))::DOUBLE / nullif(len(w), 0) AS cpw,
        len(list_filter(w, lambda x: length(x) >= 5))::DOUBLE / nullif(len(w), 0) AS poly FROM rw),
    rd AS (SELECT {key}, CASE WHEN nw > 0 THEN round(wps + 1e-9, 2) ELSE 0 END AS wps, CASE WHEN nw > 0 THEN round(cpw + 1e-9, 2) ELSE 0 END AS cpw,
        CASE WHEN nw > 0 THEN round(poly + 1e-9, 2) ELSE 0 END AS poly,
        CASE WHEN nw > 0 THEN round(greatest(0.0, least(100.0, 100 - wps * 1.5 - cpw * 3 - poly * 20)) + 1e-9, 2) ELSE 0 END AS score FROM rp)"""


ORACLE["readability"] = f"""
WITH {read_parts('documents', 'doc_id')} SELECT doc_id, wps AS words_per_sentence, cpw AS chars_per_word, poly AS long_word_ratio, score,
  score < 30 OR score > 80 AS is_unreadable FROM rd"""


def corpus(source: str, key: str) -> str:
    """CTEs `unk(key, n_words, n_unknown)` and `ppl(key, n_bigrams, perplexity)`."""
    return f"""
    tok AS (SELECT {key}, unnest({LOWER}) AS w FROM {source}),
    dfq AS (SELECT w, count(DISTINCT {key}) AS nd FROM tok GROUP BY w),
    unk AS (SELECT {key}, count(*) AS n_words, count(*) FILTER (nd < 3) AS n_unknown FROM tok JOIN dfq USING (w) GROUP BY {key}),
    lists AS (SELECT {key}, {LOWER} AS w FROM {source}),
    big AS (SELECT {key}, unnest(w[1:len(w) - 1]) AS w1, unnest(w[2:len(w)]) AS w2 FROM lists WHERE len(w) > 1),
    c2 AS (SELECT w1, w2, count(*) AS n2 FROM big GROUP BY w1, w2),
    c1 AS (SELECT w1, sum(n2) AS n1 FROM c2 GROUP BY w1),
    v AS (SELECT count(*) AS v FROM (SELECT w1 FROM c2 UNION SELECT w2 FROM c2)),
    ppl AS (SELECT {key}, count(*) AS n_bigrams, exp(-avg(ln((n2 + 1) / (n1 + v)))) AS perplexity
        FROM big JOIN c2 USING (w1, w2) JOIN c1 USING (w1), v GROUP BY {key})"""


ORACLE["unknown_word_ratio"] = f"""
WITH {corpus('documents', 'doc_id')} SELECT doc_id, n_words, n_unknown, round(n_unknown / n_words, 6) AS unknown_ratio FROM unk"""
ORACLE["corpus_perplexity"] = f"""
WITH {corpus('documents', 'doc_id')} SELECT doc_id, n_bigrams, round(perplexity, 3) AS perplexity FROM ppl"""
ORACLE["type_token_ratio"] = docs(
    type_token_ratio=f"round(len(list_distinct({LOWER}))::DOUBLE / nullif(len({LOWER}), 0), 6)"
)


def coherence(source: str, key: str) -> str:
    """CTE `coh(key, coherence)`: neighbouring sentences through term counts."""
    return f"""
    sent AS (SELECT {key}, unnest(s) AS s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT {key}, {f.sentences('lower(text)')} AS s FROM {source})),
    st AS (SELECT {key}, i, w, count(*) AS n FROM (SELECT {key}, i, unnest({f.tokens('s')}) AS w FROM sent) GROUP BY ALL),
    norm AS (SELECT {key}, i, sqrt(sum(n * n)) AS l FROM st GROUP BY ALL),
    dots AS (SELECT x.{key}, x.i, sum(x.n * y.n) AS d FROM st x JOIN st y ON y.{key} = x.{key} AND y.i = x.i + 1 AND y.w = x.w GROUP BY ALL),
    pairs AS (SELECT x.{key}, coalesce(d, 0) / (x.l * y.l) AS c FROM norm x JOIN norm y ON y.{key} = x.{key} AND y.i = x.i + 1
        LEFT JOIN dots ON dots.{key} = x.{key} AND dots.i = x.i),
    coh AS (SELECT o.{key}, coalesce(avg(c), 0) AS coherence FROM {source} o LEFT JOIN pairs USING ({key}) GROUP BY o.{key})"""


ORACLE["adjacent_coherence"] = f"WITH {coherence('documents', 'doc_id')} SELECT doc_id, round(coherence, 6) AS coherence FROM coh"


# The smallest bucket of perplexities, which grow by 1 %, that holds 95 of 100 texts with those below it
CUT = """
    bucketed AS (SELECT {key}, least(floor(ln(perplexity) / ln(1.01)), 8192) AS bucket FROM ppl),
    sketch AS (SELECT bucket, count(*) AS n FROM bucketed GROUP BY bucket),
    summed AS (SELECT bucket, sum(n) OVER (ORDER BY bucket) AS seen, sum(n) OVER () AS total FROM sketch),
    cut AS (SELECT min(bucket) AS cut FROM summed WHERE 100 * seen >= 95 * total)"""


def poor(source: str, key: str) -> str:
    """CTE `poor(key, is_poor)` over source(key, text)."""
    return f"""
    {read_parts(source, key)}, {corpus(source, key)}, {coherence(source, key)}, {CUT.format(key=key)},
    poor AS (SELECT o.{key}, len({f.tokens('text')}) < 30 OR length(text) < 200
        OR CAST(score < 30 OR score > 80 AS INTEGER) + CAST(coalesce(coherence < 0.2, false) AS INTEGER)
         + CAST(coalesce(len(list_distinct({LOWER}))::DOUBLE / nullif(len({LOWER}), 0) < 0.3, false) AS INTEGER)
         + CAST(coalesce(n_unknown / n_words > 0.05, false) AS INTEGER) + CAST(coalesce(bucket > cut, false) AS INTEGER) >= 4 AS is_poor
        FROM {source} o JOIN rd USING ({key}) JOIN coh USING ({key}) LEFT JOIN unk USING ({key}) LEFT JOIN bucketed USING ({key}), cut)"""


ORACLE["rule_poor_text"] = f"""
WITH forms AS (SELECT doc_id, {f.poor_form('text')} AS text FROM documents), {poor('forms', 'doc_id')} SELECT doc_id, is_poor FROM poor"""

ORACLE["threshold_curve"] = f"""
WITH forms AS (SELECT doc_id, {f.poor_form('text')} AS text FROM documents),
{read_parts('forms', 'doc_id')}, {corpus('forms', 'doc_id')}, {coherence('forms', 'doc_id')}, {CUT.format(key='doc_id')},
voted AS (SELECT o.doc_id, CAST(len({f.tokens('text')}) < 30 OR length(text) < 200 AS INTEGER)
    + CAST(score < 30 OR score > 80 AS INTEGER) + CAST(coalesce(coherence < 0.2, false) AS INTEGER)
    + CAST(coalesce(len(list_distinct({LOWER}))::DOUBLE / nullif(len({LOWER}), 0) < 0.3, false) AS INTEGER)
    + CAST(coalesce(n_unknown / n_words > 0.05, false) AS INTEGER) + CAST(coalesce(bucket > cut, false) AS INTEGER) AS bucket
    FROM forms o JOIN rd USING (doc_id) JOIN coh USING (doc_id) LEFT JOIN unk USING (doc_id) LEFT JOIN bucketed USING (doc_id), cut),
scores AS (SELECT 'votes' AS score, doc_id, bucket FROM voted
    UNION ALL SELECT 'unknown_words', doc_id, floor(100 * n_unknown / n_words) FROM unk
    UNION ALL SELECT 'perplexity', doc_id, bucket FROM bucketed),
counted AS (SELECT score, bucket, count(*) FILTER (quality = 0) AS bad, count(*) FILTER (quality = 1) AS good
    FROM scores JOIN labels USING (doc_id) WHERE quality IN (0, 1) GROUP BY ALL),
curve AS (SELECT score, CAST(bucket AS INTEGER) AS bucket, CAST(sum(bad) OVER w AS BIGINT) AS poor_and_bad, CAST(sum(good) OVER w AS BIGINT) AS poor_but_good,
    sum(bad) OVER (PARTITION BY score) AS all_bad FROM counted WINDOW w AS (PARTITION BY score ORDER BY bucket DESC))
SELECT score, bucket, poor_and_bad, poor_but_good, round(poor_and_bad / (poor_and_bad + poor_but_good), 6) AS precision,
  round(poor_and_bad / nullif(all_bad, 0), 6) AS recall FROM curve"""

# --- salary ------------------------------------------------------------------------------

ORACLE["extract_salary"] = f"""
WITH {f.BUSY}, {AMOUNTS} SELECT id AS post_id, section, unit, CAST(count(*) AS INTEGER) AS n_amounts, min(low) AS min_pay, max(high) AS max_pay
FROM amounts WHERE section <> 'declared' GROUP BY id, section, unit"""

# --- reports -----------------------------------------------------------------------------

ORACLE["rule_label_agreement"] = f"""
WITH {read_parts('documents', 'doc_id')}, x AS (SELECT score < 30 OR score > 80 AS poor, quality = 1 AS good FROM rd JOIN labels USING (doc_id))
SELECT count(*) FILTER (poor AND NOT good) AS poor_and_bad, count(*) FILTER (poor AND good) AS poor_but_good,
  count(*) FILTER (NOT poor AND NOT good) AS fine_but_bad, count(*) FILTER (NOT poor AND good) AS fine_and_good FROM x"""

# --- the whole moderation ------------------------------------------------------------------

INDEX_LABELS = {**RULES_OF_LABEL, 5: ("salary_conflict",), 6: ("district_province_index",), 9: ("title_index",)}
DETAIL_INDEX = DETAIL.replace(f.place_suffix("x", "province", "district"), f.place_suffix("x", OWN_PROVINCE, OWN_DISTRICT))


def distinct_blocks(names: list[str]) -> list[str]:
    blocks: list[str] = []
    for name in names:
        blocks += [b for b in RULE[name][0] if b not in blocks]
    return blocks


def stage(name: str) -> str:
    return f"r_{name} AS ({rule_select(name)})"


def label_sum(of_label: dict[int, tuple[str, ...]], labels: list[int]) -> str:
    return " + ".join(
        (lambda s: f"least({s}, 1)" if label in (2, 12) else f"({s})")(" + ".join(f"{r}_n" for r in of_label[label]))
        for label in labels
    )


def moderation(of_label: dict[int, tuple[str, ...]] = RULES_OF_LABEL) -> str:
    """CTEs up to `final`: one row per posting with `<rule>_n`, `<rule>_m` and repaired columns."""
    index = of_label is INDEX_LABELS
    first, titles = [r for label in range(1, 9) for r in of_label[label]], of_label[9]
    blocks = [DETAIL_INDEX if index and b == DETAIL else b for b in distinct_blocks(first)]
    ctes = [f.BUSY_INDEX if index else f.BUSY, *blocks, *map(stage, first)]
    joined = " ".join(f"JOIN r_{r} USING (post_id)" for r in first)
    columns = ", ".join(f"r_{r}.violations AS {r}_n, r_{r}.message AS {r}_m" for r in first)
    ctes.append(f"stage1 AS (SELECT t.*, city_codes_fixed{'' if index else ', district_fixed'}, {columns} FROM t {joined})")
    broken = " + ".join(f"{r}_n" for label in (2, 3, 4, 5, 8) for r in of_label[label])
    ctes.append(f"judged AS (SELECT *, ({broken}) > 0 OR company = '' AS returned FROM stage1)")
    wide = "(tuyển dụng )?toàn quốc"
    ctes.append(
        f"t2 AS (SELECT * REPLACE ({f.strip_phrase('title', wide)} AS title, {f.strip_phrase('description_text', wide)} AS description_text) "
        "FROM judged WHERE NOT returned)"
    )
    source = "t2"
    saved = dict(RULE)
    if index:
        ctes += [b for b in RULE["title_index"][0] if b not in ctes]
        ctes.append(f"r_title_index AS (SELECT * FROM ({rule_select('title_index')}) SEMI JOIN t2 USING (post_id))")
    for name in () if index else titles:
        title_rule(name, "title", source)
        ctes += [b for b in RULE[name][0] if b not in ctes]
        ctes.append(stage(name))
        ctes.append(f"after_{name} AS (SELECT post_id, title_fixed AS title FROM r_{name})")
        source = f"after_{name}"
    RULE.update(saved)
    ratio = RATIO.replace("FROM t)", "FROM t2)")
    ctes += [ratio, stage("special_ratio")]
    ctes.append(
        f"m_in AS (SELECT post_id, {f.html(source + '.title')} AS title, description_fixed AS body FROM fixed JOIN {source} USING (post_id))"
    )
    ctes += [f.STOP, cosines("m_in", "title", "body", "m", True)]
    ctes.append(
        f"mismatch AS (SELECT post_id, CAST({SCORE} < 0.3 AS INTEGER) AS violations FROM m_in LEFT JOIN m_cos c ON c.id = post_id LEFT JOIN m_tfidf f ON f.id = post_id)"
    )
    forms = " UNION ALL ".join(f"SELECT post_id || '/{s}' AS k, post_id, '{s}' AS section, {f.poor_form(s + '_fixed')} AS text FROM fixed" for s in SECTIONS)
    ctes.append(f"forms AS ({forms})")
    ctes.append(poor("forms", "k"))
    flags = ", ".join(f"bool_or(section = '{s}' AND is_poor) AS {s}_poor" for s in SECTIONS)
    ctes.append(f"poor_flags AS (SELECT post_id, {flags} FROM forms JOIN poor USING (k) GROUP BY post_id)")
    title_cols = ", ".join(f"coalesce(r_{r}.violations, 0) AS {r}_n, coalesce(r_{r}.message, '') AS {r}_m" for r in titles)
    plain = {s: f"judged.{s}" for s in SECTIONS} | {"description": f.strip_phrase("judged.description", wide)}
    asked = {s: f"CASE WHEN r_special_ratio.violations = 1 THEN fixed.{s}_fixed ELSE {plain[s]} END" for s in SECTIONS}
    fixed_cols = f"{asked['description']} AS description_asked, " + ", ".join(
        f"CASE WHEN judged.returned OR coalesce({s}_poor, false) THEN {asked[s]} ELSE {f.strip_special(asked[s])} END AS {s}_fixed, "
        f"coalesce({s}_poor, false) AS {s}_poor"
        for s in SECTIONS
    )
    placed = " + ".join(f"judged.{r}_n" for r in of_label[2])
    fixed_cols += f", CASE WHEN {placed} = 0 THEN {f.strip_phrase('judged.address', wide)} ELSE judged.address END AS address_fixed"
    lines = ", ".join(f"CASE WHEN {s}_poor THEN {q(content_rules.MSG_POOR[s])} END" for s in SECTIONS)
    ctes.append(
        f"final AS (SELECT judged.*, {title_cols}, {fixed_cols}, "
        f"CASE WHEN judged.returned THEN {f.strip_phrase('judged.title', wide)} ELSE {source}.title END AS title_fixed, "
        "coalesce(r_special_ratio.violations, 0) AS special_ratio_n, coalesce(r_special_ratio.message, '') AS special_ratio_m, "
        f"coalesce(mismatch.violations, 0) AS title_body_mismatch_n, CASE WHEN mismatch.violations > 0 THEN {q(content_rules.MSG_MISMATCH)} ELSE '' END AS title_body_mismatch_m, "
        "CAST(coalesce(description_poor OR requirements_poor OR benefits_poor, false) AS INTEGER) AS poor_text_n, "
        f"concat_ws(chr(10), {lines}) AS poor_text_m "
        f"FROM judged {' '.join(f'LEFT JOIN r_{r} USING (post_id)' for r in titles)} LEFT JOIN {source} USING (post_id) "
        "LEFT JOIN r_special_ratio USING (post_id) LEFT JOIN fixed USING (post_id) LEFT JOIN mismatch USING (post_id) LEFT JOIN poor_flags USING (post_id))"
    )
    ctes.append(
        f"done AS (SELECT *, CAST(CASE WHEN returned THEN {label_sum(of_label, list(range(1, 9)))} ELSE {label_sum(of_label, list(range(1, 13)))} END AS INTEGER) AS num_error, "
        f"CASE WHEN returned THEN 0 WHEN special_ratio_n = 1 OR title_body_mismatch_n > 0 OR poor_text_n > 0 THEN 4 "
        f"WHEN {'false' if index else ' + '.join(r + '_n' for r in titles) + ' > 0'} THEN 2 ELSE 1 END AS status FROM final)"
    )
    return "WITH RECURSIVE " + ",\n".join(ctes)


MODERATED = moderation()
TEXT_OF_STATUS = "CASE status " + " ".join(f"WHEN {k} THEN {q(v)}" for k, v in STATUS_TEXT.items()) + " END"
ORACLE["num_error"] = f"{MODERATED} SELECT post_id, returned, num_error FROM done"
ORACLE["verdict"] = f"{MODERATED} SELECT post_id, num_error, status, {TEXT_OF_STATUS} AS status_text FROM done"
ORACLE["moderate_stream"] = ORACLE["verdict"]
ORACLE["moderate_index"] = f"""{moderation(INDEX_LABELS)}
SELECT post_id, returned, num_error, status, {', '.join(f'{r}_n AS {r}' for r in ('salary_conflict', 'district_province_index', 'title_index'))} FROM done"""
ORACLE["stream_corpus_state"] = f"""{MODERATED}, words AS (SELECT k, unnest({LOWER}) AS token FROM forms)
SELECT token, count(*) AS n_rows, count(DISTINCT k) AS n_docs FROM words GROUP BY token"""
ORACLE["worst_postings"] = f"""{MODERATED} SELECT source, post_id, CAST(r AS INTEGER) AS rank, num_error FROM
  (SELECT *, row_number() OVER (PARTITION BY source ORDER BY num_error DESC, post_id) AS r FROM done) WHERE r <= 3"""


def label_text(label: int) -> str:
    rules = RULES_OF_LABEL[label]
    if len(rules) == 1 and label != 6:
        return f"{rules[0]}_m"
    single = "flatten([" + ", ".join(f"string_split({r}_m, chr(10))" for r in rules) + "])"
    filled = f"list_filter({single}, lambda x: x <> '')"
    return f"array_to_string(list_transform({filled}, lambda x, i: i || ', ' || x), chr(10))"


ORACLE["message_map"] = MODERATED + " SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT post_id, 'Điều kiện {i}' AS label, {label_text(i)} AS message FROM done{' WHERE NOT returned' if i > 8 else ''}"
    for i in range(1, 13)
) + ") WHERE message <> ''"
REPAIRED = ["title", "description", "requirements", "benefits", "city_codes", "district", "address"]
ORACLE["repaired_fields"] = MODERATED + " " + " UNION ALL ".join(
    f"SELECT post_id, '{c}' AS field, {c} AS original, coalesce({c}_fixed, {c}) AS repaired FROM done WHERE {c} IS DISTINCT FROM coalesce({c}_fixed, {c})"
    for c in REPAIRED
)
FAILS = "title_body_mismatch_n > 0"
ORACLE["rewrite_queue"] = f"""{MODERATED} SELECT post_id, {FAILS} AS with_title, concat_ws(chr(10),
  CASE WHEN {FAILS} THEN {q(rewrite.PROMPT_WITH_TITLE)} ELSE {q(rewrite.PROMPT_WITHOUT_TITLE)} END,
  CASE WHEN {FAILS} THEN 'Tiêu đề:' || chr(10) || title_fixed END,
  CASE WHEN {FAILS} OR description_poor THEN 'Mô tả:' || chr(10) || description_asked END,
  CASE WHEN requirements_poor THEN 'Yêu cầu:' || chr(10) || requirements_fixed END,
  CASE WHEN benefits_poor THEN 'Quyền lợi:' || chr(10) || benefits_fixed END) AS prompt
FROM done WHERE {FAILS} OR description_poor OR requirements_poor OR benefits_poor"""

LONG_FORM = " UNION ALL ".join(
    f"SELECT post_id, source, '{r}' AS rule_id, CAST({r}_n AS INTEGER) AS count, {r}_m AS message FROM done WHERE {r}_n > 0"
    for label in range(1, 13)
    for r in RULES_OF_LABEL[label]
)
ORACLE["violations"] = f"{MODERATED} SELECT post_id, rule_id, count, message FROM ({LONG_FORM})"
ORACLE["rule_report"] = f"""{MODERATED}
SELECT rule_id, source, CAST(grouping(rule_id, source) AS BIGINT) AS level, count(*) AS postings, CAST(sum(count) AS BIGINT) AS errors
FROM ({LONG_FORM}) GROUP BY ROLLUP (rule_id, source)"""
ORACLE["short_circuit"] = f"""
WITH RECURSIVE {', '.join((f.BUSY, *MISMATCH))}, a AS ({rule_select('company_form')}), b AS ({rule_select('title_body_mismatch')})
SELECT post_id, a.violations AS company_form_count, CASE WHEN a.violations > 0 THEN 0 ELSE b.violations END AS mismatch
FROM a JOIN b USING (post_id)"""
ORACLE["write_moderated"] = f"""{MODERATED}
SELECT post_id, status, {TEXT_OF_STATUS} AS status_text, CAST(NULL AS VARCHAR) AS error, title_fixed AS title, description_fixed AS description,
  address_fixed AS address, district_fixed AS district, num_error, company_form_m AS company_message FROM done"""

# --- rewriting ---------------------------------------------------------------------------

NAMES = r"Tiêu\s+đề|Mô\s+tả\s+công\s+việc|Mô\s+tả|Yêu\s+cầu\s+ứng\s+viên|Yêu\s+cầu|Quyền\s+lợi"
MARKS = r"(?:\s*\*\*|\s*:\s*\*?\*?)?\s*"


def cut(c: str, mark: str) -> str:
    return f"CASE WHEN contains({c}, {mark}) THEN regexp_replace(string_split({c}, {mark})[1], '\\s+$', '') ELSE {c} END"


def parsed(source: str, keys: str) -> str:
    """CTE `parsed(keys, pos, heading, content, error)`."""
    return f"""
    cut0 AS (SELECT {keys}, regexp_extract_all(text, {q('(?i)' + NAMES)}) AS hs, string_split_regex(text, {q('(?i)(?:' + NAMES + ')' + MARKS)}) AS bs FROM {source}),
    cut1 AS (SELECT {keys}, unnest(range(1, len(hs) + 1)) AS i, unnest(hs) AS heading, unnest(bs[2:]) AS body FROM cut0 WHERE len(hs) > 0),
    cut2 AS (SELECT {keys}, heading, min(i) AS first, arg_max({f.strip_special(cut(f.trim_space('body'), "'---'"))}, i) AS content FROM cut1 GROUP BY ALL),
    cut3 AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY first) AS pos, count(*) OVER (PARTITION BY {keys}) AS n FROM cut2),
    parsed AS (SELECT {keys}, CAST(pos AS INTEGER) AS pos, heading, CASE WHEN pos = n THEN {cut('content', 'chr(10) || chr(10)')} ELSE content END AS content,
            CAST(NULL AS VARCHAR) AS error FROM cut3
        UNION ALL SELECT {keys}, 0, NULL, NULL, {q(rewrite.NO_HEADING)} FROM cut0 WHERE len(hs) = 0)"""


ORACLE["parse_rewrite"] = f"WITH {f.ANSWERS}, {parsed('answers', 'conv_id, turn')} SELECT * FROM parsed"


def newest(field: str, short: str, long: str | None) -> str:
    names = [short] + ([long] if long else [])
    listed = ", ".join(q(n) for n in names)
    last = f"(SELECT content FROM usable u WHERE u.post_id = p.post_id AND name IN ({listed}) ORDER BY turn DESC, length(name), pos LIMIT 1)"
    return f"coalesce('<p>' || replace({last}, chr(10), '<br />') || '</p>', {field}) AS {field}"


ORACLE["merge_rewrite"] = f"""
WITH {f.BUSY}, {f.ANSWERS}, every AS (SELECT conv_id AS post_id, turn, text FROM answers),
{parsed('every', 'post_id, turn')},
usable AS (SELECT post_id, turn, pos, content, lower(regexp_replace(heading, '\\s+', ' ', 'g')) AS name FROM parsed
    WHERE error IS NULL AND regexp_matches(heading, '^\\p{{Lu}}') AND content <> '')
SELECT post_id, {newest('title', 'tiêu đề', None)}, {newest('description', 'mô tả', 'mô tả công việc')},
  {newest('requirements', 'yêu cầu', 'yêu cầu ứng viên')}, {newest('benefits', 'quyền lợi', None)} FROM p"""
