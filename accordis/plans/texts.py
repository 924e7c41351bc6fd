"""Queries on ids, texts and almost-JSON (P5-P14, K3, S4, S6, S7, F1-F16, J1-J11, V1, SO8, DD2)."""

from pyspark.sql import functions as F

from ..functions import dirtyjson as j
from ..functions import identifiers as ids
from ..functions import text as x
from ..tables import RELATIONS
from .registry import query

RELATIONS["raw_ids"] = """SELECT p_partkey AS seq, CASE p_size % 4 WHEN 0 THEN 'pycg' WHEN 1 THEN 'pyan' WHEN 2 THEN 'java' ELSE 'ts' END AS kind,
    CASE p_size % 4 WHEN 0 THEN CASE WHEN p_size % 5 = 0 THEN concat('<', p_name, '>') ELSE concat('app', CASE WHEN p_size % 3 = 0 THEN '.' ELSE '' END, replace(p_name, ' ', '.')) END
    WHEN 1 THEN CASE WHEN p_size % 5 = 0 THEN concat(' a->', p_brand) ELSE concat(' mod.', p_brand, ' ') END WHEN 2 THEN concat('com.x.', p_brand, '(int)') ELSE concat('src/', p_brand, '/', p_type, '.ts') END AS raw FROM part"""
RELATIONS["callees"] = """SELECT p_partkey AS seq, CASE p_size % 5 WHEN 0 THEN concat('app.', CASE WHEN p_size % 2 = 0 THEN 'filter' ELSE 'run' END) WHEN 1 THEN concat('os.path.', p_type) WHEN 2 THEN 'print' WHEN 3 THEN concat('json.', p_name) ELSE concat('pkg.', p_type) END AS callee FROM part"""
# What a row's text was meant to say, and the text as it came: whole, cut, or with one of the faults that repair knows.
MEANT = """concat('{"summary":"', event_type, ' http://x.io/', CAST(user_id AS STRING), '","n":', CAST(event_id AS STRING), ',"tags":["a","', event_type, '"],"in":{"ok":true,"none":null}}')"""
RELATIONS["damaged"] = f"""SELECT event_id AS id, event_type, CASE event_id % 16 WHEN 0 THEN substring({MEANT}, 1, length({MEANT}) - 2) WHEN 1 THEN replace({MEANT}, '"', chr(39)) WHEN 2 THEN replace(replace({MEANT}, '}}', ', }}'), ']', ',]')
    WHEN 3 THEN concat('```json', chr(10), {MEANT}, chr(10), '```') WHEN 4 THEN replace(replace({MEANT}, 'true', 'True'), 'null', 'None') WHEN 5 THEN replace({MEANT}, 'null', 'NaN') WHEN 6 THEN concat('Here it is: ', {MEANT}, ' done')
    WHEN 7 THEN replace(replace({MEANT}, '"n":', 'n:'), '"in":', 'in : ') WHEN 8 THEN replace({MEANT}, ',"n"', concat(', // it''s "the" number', chr(10), '"n"')) WHEN 9 THEN replace({MEANT}, '"n":', '/* a , b */"n":')
    WHEN 10 THEN replace(replace({MEANT}, ',"n"', ' "n"'), '"a","', '"a" "') WHEN 11 THEN concat('```', chr(10), replace({MEANT}, ',"tags"', ' "tags"'), chr(10), '```') WHEN 12 THEN replace(replace({MEANT}, ':{{', ':['), '}}}}', ']}}')
    WHEN 13 THEN substring({MEANT}, 1, length({MEANT}) - 20) WHEN 14 THEN ' ' ELSE {MEANT} END AS text FROM events"""
RELATIONS["comments"] = """SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN concat('RESOLUTION: accept_a', chr(10), role) WHEN 1 THEN concat('resolution: Merge ', role) WHEN 2 THEN concat('note ', role) WHEN 3 THEN 'RESOLUTION: manual' ELSE concat('see bd-', CAST(conv_id AS STRING)) END AS comment FROM conversations"""


@query("p5_normal_ids", """SELECT seq, nullif(trim(CASE kind WHEN 'pycg' THEN CASE WHEN NOT (raw LIKE '<%' OR raw LIKE '%>') THEN raw END WHEN 'pyan' THEN CASE WHEN NOT contains(trim(raw), '->') THEN trim(raw) END
    WHEN 'java' THEN trim(split_part(split_part(raw, '(', 1), ')', 1)) ELSE regexp_replace(regexp_replace(raw, '\\.(ts|js)$', ''), '[/\\\\]', '.', 'g') END), '') AS id FROM {raw_ids} r""")
def _(t):
    return t.raw_ids.select("seq", ids.normal_id(F.col("raw"), F.col("kind")).alias("id"))


@query("p6_strip_prefix", "SELECT seq, regexp_replace(CASE WHEN starts_with(raw, 'app') THEN substr(raw, 4) ELSE raw END, '^\\.', '') AS loose, lower(regexp_replace(CASE WHEN starts_with(raw, 'app.') OR raw = 'app' THEN substr(raw, 4) ELSE raw END, '^\\.', '')) AS strict FROM {raw_ids} r")
def _(t):
    return t.raw_ids.select("seq", ids.strip_prefix(F.col("raw"), "app").alias("loose"), ids.strip_prefix(F.col("raw"), "app", at_dot=True, lower=True).alias("strict"))


_BUILTIN = "split_part(callee, '.', -1) IN (" + ", ".join(f"'{b}'" for b in ids.BUILTINS) + ")"
_STDLIB = " OR ".join(f"starts_with(callee, '{p}')" for p in ids.STDLIB)
_EXCLUDED = f"CASE WHEN {_BUILTIN} THEN 'builtin' WHEN {_STDLIB} THEN 'stdlib' ELSE 'kept' END"


@query("p7_exclusion", f"SELECT seq, callee, {_EXCLUDED} AS exclusion FROM {{callees}} c")
def _(t):
    return t.callees.select("seq", "callee", ids.exclusion(F.col("callee")).alias("exclusion"))


@query("p8_normalization_stats", f"SELECT count(*) AS raw, count(*) FILTER (e = 'kept') AS kept, count(*) FILTER (e = 'builtin') AS builtin, count(*) FILTER (e = 'stdlib') AS stdlib FROM (SELECT {_EXCLUDED} AS e FROM {{callees}} c)")
def _(t):
    e = ids.exclusion(F.col("callee"))
    return t.callees.agg(F.count(F.lit(1)).alias("raw"), *(F.count_if(e == k).alias(k) for k in ("kept", "builtin", "stdlib")))


@query("p9_call_type", """SELECT event_id, CASE WHEN contains(h, 'conditional') OR contains(h, 'if') THEN 'conditional' WHEN contains(h, 'loop') OR contains(h, 'for') OR contains(h, 'while') THEN 'loop' WHEN contains(h, 'try') OR contains(h, 'except') THEN 'exception'
    WHEN contains(h, 'callback') OR contains(h, 'lambda') THEN 'callback' WHEN contains(h, 'dynamic') OR contains(h, 'getattr') THEN 'dynamic' ELSE 'direct' END AS call_type
    FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'Notify' WHEN 'click' THEN 'in while' WHEN 'error' THEN 'except' WHEN 'signup' THEN 'a lambda' ELSE 'plain' END AS raw, lower(raw) AS h FROM events)""")
def _(t):
    hint = F.when(F.col("event_type") == "view", "Notify").when(F.col("event_type") == "click", "in while").when(F.col("event_type") == "error", "except").when(F.col("event_type") == "signup", "a lambda").otherwise("plain")
    return t.events.select("event_id", ids.call_type(hint).alias("call_type"))


@query("p10_module_of_path", "SELECT p_partkey AS seq, regexp_replace(replace(regexp_replace(path, '\\.py$', ''), '/', '.'), '(^|\\.)__init__$', '') AS module FROM (SELECT p_partkey, concat('src/', replace(p_name, ' ', '/'), CASE WHEN p_size % 2 = 0 THEN '/__init__.py' ELSE '/main.py' END) AS path FROM part)")
def _(t):
    path = F.concat(F.lit("src/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.when(F.col("p_size") % 2 == 0, "/__init__.py").otherwise("/main.py"))
    return t.part.select(F.col("p_partkey").alias("seq"), ids.module_of_path(path).alias("module"))


@query("p11_visibility", "SELECT p_partkey AS seq, NOT starts_with(n, '_') AS is_public FROM (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN concat('_', p_name) ELSE p_name END AS n FROM part)")
def _(t):
    return t.part.select(F.col("p_partkey").alias("seq"), ids.is_public(F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("_"), "p_name")).otherwise(F.col("p_name"))).alias("is_public"))


@query("p12_excluded", "SELECT page_id, url FROM pages WHERE NOT (contains(url, 'm.') OR contains(url, '/fr/'))")
def _(t):
    return t.pages.filter(~ids.excluded_by(F.col("url"), ["m.", "/fr/"])).select("page_id", "url")


@query("p13_ignore_patterns", "SELECT page_id, CASE WHEN trim(l) <> '' AND NOT starts_with(trim(l), '#') THEN nullif(replace(replace(regexp_replace(trim(l), '/$', ''), '*', ''), '/', '.'), '') END AS pattern FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN concat('# ', url) WHEN 1 THEN concat(url, '/') WHEN 2 THEN '  ' ELSE concat('*', url) END AS l FROM pages)")
def _(t):
    n = F.col("page_id") % 4
    line = F.when(n == 0, F.concat(F.lit("# "), "url")).when(n == 1, F.concat("url", F.lit("/"))).when(n == 2, "  ").otherwise(F.concat(F.lit("*"), "url"))
    return t.pages.select("page_id", ids.ignore_pattern(line).alias("pattern"))


@query("p14_segments", "SELECT seq, CASE WHEN contains(callee, '.') THEN regexp_replace(callee, '\\.[^.]*$', '') ELSE '' END AS module_path, split_part(callee, '.', -1) AS name FROM {callees} c")
def _(t):
    return t.callees.select("seq", ids.module_path(F.col("callee")).alias("module_path"), ids.last_segment(F.col("callee")).alias("name"))


@query("k3_safe_names", "SELECT page_id, trim(right(regexp_replace(regexp_replace(url, '[<>:\"/\\\\|?*.]', '_', 'g'), '_+', '_', 'g'), 200), '_') AS name FROM pages")
def _(t):
    return t.pages.select("page_id", ids.safe_name(F.col("url")).alias("name"))


@query("v1_violations", "SELECT event_id, value < 1 OR value > 60 AS bad_range, NOT regexp_matches(n, '^\\**[A-Za-z_][A-Za-z0-9_]*$') AS bad_name FROM (SELECT event_id, value, CASE event_id % 3 WHEN 0 THEN concat('**', event_type) WHEN 1 THEN concat(event_type, '-x') ELSE event_type END AS n FROM events) WHERE value < 1 OR value > 60 OR NOT regexp_matches(n, '^\\**[A-Za-z_][A-Za-z0-9_]*$')")
def _(t):
    n = F.col("event_id") % 3
    name = F.when(n == 0, F.concat(F.lit("**"), "event_type")).when(n == 1, F.concat("event_type", F.lit("-x"))).otherwise(F.col("event_type"))
    checked = t.events.select("event_id", ((F.col("value") < 1) | (F.col("value") > 60)).alias("bad_range"), (~ids.is_identifier(name)).alias("bad_name"))
    return checked.filter("bad_range OR bad_name")


@query("f1_jaccard", """WITH w AS (SELECT doc_id, text_a, text_b, list_distinct(list_filter(string_split_regex(lower(text_a), '\\s+'), lambda w: w <> '')) AS a, list_distinct(list_filter(string_split_regex(lower(text_b), '\\s+'), lambda w: w <> '')) AS b FROM {pairs} p)
    SELECT doc_id, round(CASE WHEN text_a = text_b THEN 1.0::DOUBLE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) END, 9) AS similarity FROM w""")
def _(t):
    return t.pairs.select("doc_id", F.round(x.jaccard(F.col("text_a"), F.col("text_b")), 9).alias("similarity"))


@query("f2_cosine", """WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY doc_id, w), s AS (SELECT doc_id, sqrt(sum(n * n)::DOUBLE) AS norm FROM c GROUP BY doc_id)
    SELECT a.doc_id, round(sum(a.n * b.n)::DOUBLE / (any_value(x.norm) * any_value(y.norm)), 6) AS similarity FROM c a JOIN c b ON b.doc_id = a.doc_id + 1 AND a.w = b.w JOIN s x ON x.doc_id = a.doc_id JOIN s y ON y.doc_id = b.doc_id GROUP BY a.doc_id""")
def _(t):
    counts = t.documents.select("doc_id", F.explode(x.words(F.col("text"))).alias("w")).groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("n"))
    norms = counts.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("norm"))
    dots = counts.join(counts.select((F.col("doc_id") - 1).alias("doc_id"), "w", F.col("n").alias("m")), ["doc_id", "w"]).groupBy("doc_id").agg(F.sum(F.col("n") * F.col("m")).cast("double").alias("dot"))
    rated = dots.join(norms, "doc_id").join(norms.select((F.col("doc_id") - 1).alias("doc_id"), F.col("norm").alias("other")), "doc_id")
    return rated.select("doc_id", F.round(F.col("dot") / (F.col("norm") * F.col("other")), 6).alias("similarity"))


def traces(t):
    roles = t.conversations.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda r: r["role"]).alias("roles"))
    return roles.join(roles.select((F.col("conv_id") - 1).alias("conv_id"), F.col("roles").alias("other")), "conv_id")


ROLES = "(SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY conv_id)"
# The table of lengths, a row for each entry of b; lists of one number stand for places, as a fold's steps must be of its result's kind.
LCS = """list_reduce(list_transform(range(1, len(b) + 1), lambda j: [j]), lambda past, y: list_reduce(list_transform(range(1, len(a) + 1), lambda i: [i]),
    lambda now, x: list_append(now, CASE WHEN a[x[1]] = b[y[1]] THEN past[x[1]] + 1 ELSE greatest(now[-1], past[x[1] + 1]) END), [0::BIGINT]), list_transform(range(0, len(a) + 1), lambda z: 0::BIGINT))[-1]::DOUBLE / greatest(len(a), len(b))"""


@query("f3_lcs_similarity", f"SELECT conv_id, {LCS} AS similarity FROM (SELECT x.conv_id, x.roles AS a, y.roles AS b FROM {ROLES} x JOIN {ROLES} y ON y.conv_id = x.conv_id + 1)")
def _(t):
    """Longest common subsequence of role sequences."""
    return traces(t).select("conv_id", x.lcs_similarity(F.col("roles"), F.col("other")).alias("similarity"))


@query("f4_scenario_parts", """WITH r AS (SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY conv_id) SELECT a.conv_id, a.roles[1] IS NOT DISTINCT FROM b.roles[1] AS output_correct,
    CASE WHEN len(list_distinct(a.roles)) = 0 THEN 1.0::DOUBLE ELSE round(len(list_intersect(list_distinct(a.roles), b.roles))::DOUBLE / len(list_distinct(a.roles)), 6) END AS effects, len(list_filter(a.roles, lambda x: NOT list_contains(b.roles, x))) AS missed_calls FROM r a JOIN r b ON b.conv_id = a.conv_id + 1""")
def _(t):
    return evaluated(t).select("conv_id", "e.output_correct", "e.effects", F.size("e.missed_calls").cast("long").alias("missed_calls"))


def evaluated(t):
    first = lambda c: F.get(c, F.lit(0))
    return traces(t).withColumn("e", x.scenario_evaluation(F.col("roles"), F.col("other"), first("roles"), first("other"), F.col("roles"), F.col("other"), F.lit(True)))


@query("f4_scenario_score", f"""SELECT conv_id, round(s * 0.4::DOUBLE + (a[1] IS NOT DISTINCT FROM b[1])::INT * 0.3::DOUBLE + len(list_intersect(list_distinct(a), b))::DOUBLE / len(list_distinct(a)) * 0.3::DOUBLE, 6) AS overall, round(s, 6) AS sequence
    FROM (SELECT *, {LCS} AS s FROM (SELECT x.conv_id, x.roles AS a, y.roles AS b FROM {ROLES} x JOIN {ROLES} y ON y.conv_id = x.conv_id + 1))""")
def _(t):
    return evaluated(t).select("conv_id", "e.overall", "e.sequence")


@query("f5_outputs_match", "SELECT doc_id, lower(trim(text_a)) IS NOT DISTINCT FROM lower(trim(text_b)) AS matches FROM {pairs} p")
def _(t):
    return t.pairs.select("doc_id", x.outputs_match(F.col("text_a"), F.col("text_b")).alias("matches"))


@query("f6_reconstruction", """SELECT doc_id, CASE WHEN trim(text) = trim(g) THEN 1.0::DOUBLE WHEN lower(regexp_replace(trim(text), '\\s+', ' ', 'g')) = lower(regexp_replace(trim(g), '\\s+', ' ', 'g')) THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END AS score
    FROM (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN concat(' ', text) WHEN 1 THEN replace(text, ' ', '  ') ELSE lang END AS g FROM documents)""")
def _(t):
    n = F.col("doc_id") % 4
    given = F.when(n == 0, F.concat(F.lit(" "), "text")).when(n == 1, F.replace("text", F.lit(" "), F.lit("  "))).otherwise(F.col("lang"))
    return t.documents.select("doc_id", x.reconstruction_score(F.col("text"), given).alias("score"))


@query("f7_mask_counts", "SELECT doc_id, len(regexp_extract_all(text, '\\b\\d+\\.?\\d*\\b')) AS constants, len(regexp_extract_all(text, '\\w+\\s*\\(')) AS calls FROM documents")
def _(t):
    plain = t.documents.select("doc_id", x.mask_count(F.col("text"), "constants").cast("long").alias("constants"), x.mask_count(F.col("text"), "function_calls").cast("long").alias("calls"))
    return plain


@query("f7_masked_text")
def _(t):
    """Which matches are masked follows from a hash; unit tests hold spans and overlaps against a table."""
    return t.documents.select("doc_id", x.masked_by_all(F.col("text"), ("constants", "strings", "function_calls"), 30).alias("m")).select("doc_id", "m.*")


@query("f8_signature", "SELECT p_partkey AS seq, CASE WHEN regexp_extract(s, '(?m)^(def\\s+\\w+\\s*\\([^)]*\\).*?:)', 1) = '' THEN 'def unknown():' ELSE regexp_extract(s, '(?m)^(def\\s+\\w+\\s*\\([^)]*\\).*?:)', 1) END AS signature FROM (SELECT p_partkey, concat('x = 1', chr(10), CASE WHEN p_size % 4 = 0 THEN 'pass' ELSE concat('def f', p_size, '(a, b) -> int:', chr(10), '  pass') END) AS s FROM part)")
def _(t):
    source = F.concat(F.lit("x = 1\n"), F.when(F.col("p_size") % 4 == 0, "pass").otherwise(F.concat(F.lit("def f"), "p_size", F.lit("(a, b) -> int:\n  pass"))))
    return t.part.select(F.col("p_partkey").alias("seq"), x.signature(source).alias("signature"))


@query("f9_resolutions", """WITH p AS (SELECT conv_id, turn, nullif(lower(regexp_extract(comment, '(?is)RESOLUTION:\\s*(accept_a|accept_b|merge|manual)\\s*\\n?(.*)', 1)), '') AS action, nullif(trim(regexp_extract(comment, '(?is)RESOLUTION:\\s*(?:accept_a|accept_b|merge|manual)\\s*\\n?(.*)', 1)), '') AS content FROM {comments} c)
    SELECT conv_id, arg_max(action, turn) AS action, arg_max(turn, turn) AS turn FROM p WHERE action IS NOT NULL GROUP BY conv_id""")
def _(t):
    found = t.comments.select("conv_id", "turn", x.resolution_action(F.col("comment")).alias("action")).filter("action IS NOT NULL")
    return found.groupBy("conv_id").agg(F.max_by("action", "turn").alias("action"), F.max("turn").alias("turn"))


@query("f9_resolution_contents", "SELECT conv_id, turn, nullif(trim(regexp_extract(comment, '(?is)RESOLUTION:\\s*(?:accept_a|accept_b|merge|manual)\\s*\\n?(.*)', 1)), '') AS content FROM {comments} c")
def _(t):
    return t.comments.select("conv_id", "turn", x.resolution_content(F.col("comment")).alias("content"))


@query("f10_ticket_ids", "SELECT conv_id, turn, nullif(regexp_extract(comment, '(bd-[a-z0-9]+)', 1), '') AS ticket FROM {comments} c")
def _(t):
    return t.comments.select("conv_id", "turn", x.ticket_id(F.col("comment")).alias("ticket"))


@query("f12_summaries", """WITH h AS (SELECT doc_id, text, substr(text, 1, 197) AS h FROM documents), s AS (SELECT *, CASE WHEN contains(h, ' ') THEN length(h) - strpos(reverse(h), ' ') + 1 ELSE 0 END AS sp FROM h)
    SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE concat(CASE WHEN sp > 0 AND sp - 1 > 150 THEN substr(h, 1, sp - 1) ELSE h END, '...') END AS summary FROM s""")
def _(t):
    return t.documents.select("doc_id", x.summary(F.col("text")).alias("summary"))


@query("f13_locations", "SELECT l_orderkey AS id, concat(l_returnflag, '.py:', l_linenumber, '-', l_linenumber + l_suppkey) AS location FROM lineitem")
def _(t):
    return t.lineitem.select(F.col("l_orderkey").alias("id"), F.concat("l_returnflag", F.lit(".py:"), "l_linenumber", F.lit("-"), F.col("l_linenumber") + F.col("l_suppkey")).alias("location"))


@query("f14_iso_times", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE epoch_us(date_trunc('second', ts)) END AS micros FROM events""")
def _(t):
    text = F.when(F.col("event_id") % 5 == 0, "not a time").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    return t.events.select("event_id", F.unix_micros(x.iso_time(text)).alias("micros"))


@query("f15_durations", "SELECT ticket_key, date_diff('second', created_at, timeout_at) AS seconds FROM {tickets} t")
def _(t):
    return t.tickets.select("ticket_key", F.floor((F.unix_micros(F.col("timeout_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 1_000_000).cast("long").alias("seconds"))


@query("f16_still_valid", "SELECT ticket_key, complexity % 3 = 0 OR TIMESTAMP '1998-01-01' <= created_at + to_hours(CAST(complexity % 3 * 8760 AS INTEGER)) AS valid FROM {tickets} t")
def _(t):
    return t.tickets.select("ticket_key", x.still_valid(F.col("created_at").cast("timestamp"), F.lit("1998-01-01").cast("timestamp"), F.col("complexity") % 3 * 8760).alias("valid"))


@query("dd2_content_mismatch", """WITH p AS (SELECT doc_id, x.kind, x.least, CASE x.kind WHEN 'summary' THEN substring(text_a, 1, 40) ELSE text_a END AS text_a, CASE x.kind WHEN 'summary' THEN substring(text_b, 1, 40) ELSE text_b END AS text_b
    FROM {pairs} p, (VALUES ('summary', 0.9), ('description', 0.85)) x(kind, least)),
    w AS (SELECT *, list_distinct(list_filter(string_split_regex(lower(text_a), '\\s+'), lambda w: w <> '')) AS a, list_distinct(list_filter(string_split_regex(lower(text_b), '\\s+'), lambda w: w <> '')) AS b FROM p),
    s AS (SELECT doc_id, kind, least, CASE WHEN text_a = text_b THEN 1.0::DOUBLE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) END AS c FROM w)
    SELECT doc_id, kind, round(c, 9) AS confidence FROM s WHERE c < least""")
def _(t):
    head = lambda c: F.substring(c, 1, 40)
    found = x.content_mismatch(head("text_a"), head("text_b"), F.col("text_a"), F.col("text_b"))
    return t.pairs.select("doc_id", F.explode(found).alias("m")).select("doc_id", "m.*")


@query("so8_gap_dedupe", "SELECT source AS area, lang AS description, min(doc_id) AS first_id FROM documents GROUP BY source, lang")
def _(t):
    return t.documents.groupBy(F.col("source").alias("area"), F.col("lang").alias("description")).agg(F.min("doc_id").alias("first_id"))


@query("s4_adjacency_json", "SELECT concat('u', user_id) AS caller, event_type AS callee FROM events WHERE event_id % 3 <> 0")
def _(t):
    """{caller: [callee]} texts; those that aren't JSON give nothing."""
    text = F.when(F.col("event_id") % 3 == 0, F.lit("{broken")).otherwise(F.to_json(F.create_map(F.concat(F.lit("u"), "user_id"), F.array("event_type"))))
    parsed = t.events.select(F.from_json(text, "map<string,array<string>>").alias("m"))
    return parsed.select(F.explode("m").alias("caller", "callees")).select("caller", F.explode("callees").alias("callee"))


@query("s6_edge_list_json", "SELECT concat('u', user_id) AS caller, event_type AS callee FROM events WHERE value < 30 AND event_id % 5 <> 0")
def _(t):
    edge = F.struct(F.concat(F.lit("u"), "user_id").alias("source"), F.col("event_type").alias("target"), F.when(F.col("value") < 30, "uses").otherwise("defines").alias("flavor"))
    text = F.when(F.col("event_id") % 5 == 0, F.lit(" ")).otherwise(F.to_json(F.struct(F.array(edge).alias("graph"))))
    parsed = t.events.select(F.from_json(text, "graph array<struct<source:string,target:string,flavor:string>>").alias("g"))
    return parsed.select(F.explode("g.graph").alias("e")).filter("e.flavor = 'uses'").select(F.col("e.source").alias("caller"), F.col("e.target").alias("callee"))


@query("s7_jsonl_source", "SELECT event_id AS seq, user_id AS run_id, event_type AS type FROM events WHERE event_id % 4 NOT IN (1, 2)")
def _(t):
    """Log lines: blank and malformed ones are skipped."""
    n = F.col("event_id") % 4
    line = F.when(n == 1, "").when(n == 2, '{"seq": ').otherwise(F.to_json(F.struct(F.col("event_id").alias("seq"), F.col("user_id").alias("run_id"), F.col("event_type").alias("type"))))
    parsed = t.events.select(F.from_json(line, "seq long, run_id long, type string, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return parsed.filter("r IS NOT NULL AND r._corrupt_record IS NULL AND r.seq IS NOT NULL").select("r.seq", "r.run_id", "r.type")


@query("j1_strip_fence", "SELECT id, trim(regexp_replace(regexp_replace(trim(text), '^```[a-zA-Z]*\\s*', ''), '\\s*```$', '')) AS text FROM {damaged} d")
def _(t):
    return t.damaged.select("id", j.strip_fence(F.col("text")).alias("text"))


@query("j2_repair", f"""SELECT event_id AS id, CASE event_id % 16 WHEN 0 THEN substring({MEANT}, 1, length({MEANT}) - 2) WHEN 3 THEN concat('```json', chr(10), {MEANT}, chr(10), '```') WHEN 6 THEN concat('Here it is: ', {MEANT}, ' done')
    WHEN 7 THEN replace({MEANT}, '"in":', '"in" : ') WHEN 8 THEN replace({MEANT}, ',"n"', concat(', ', chr(10), '"n"')) WHEN 10 THEN replace(replace({MEANT}, ',"n"', ', "n"'), '"a","', '"a", "')
    WHEN 11 THEN concat('```', chr(10), replace({MEANT}, ',"tags"', ', "tags"'), chr(10), '```') WHEN 12 THEN replace(replace({MEANT}, ':{{', ':[{{'), '}}}}', '}}]}}') WHEN 13 THEN substring({MEANT}, 1, length({MEANT}) - 20) WHEN 14 THEN '{{}}'
    ELSE {MEANT} END AS text FROM events""")
def _(t):
    return t.damaged.select("id", j.repair(F.col("text")).alias("text"))


@query("j3_balance", "SELECT event_id AS id, CASE event_id % 2 WHEN 0 THEN concat('{{', rtrim(replace(props, '}', '')), '}}}') ELSE concat('[[', rtrim(props), ']]') END AS text FROM events")
def _(t):
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("{{"), F.regexp_replace("props", r"\}", ""))).otherwise(F.concat(F.lit("[["), "props"))
    return t.events.select(F.col("event_id").alias("id"), j.balance(text).alias("text"))


@query("j4_cascade", f"""SELECT event_id AS id, CASE event_id % 16 WHEN 14 THEN '{{}}' WHEN 13 THEN concat('{{"summary":"', event_type, ' http://x.io/', CAST(user_id AS STRING), '"}}') WHEN 12 THEN replace(replace({MEANT}, ':{{', ':[{{'), '}}}}', '}}]}}') ELSE {MEANT} END AS json FROM events""")
def _(t):
    return t.damaged.select("id", j.parse(F.col("text")).alias("json"))


@query("j5_partial_fields", """SELECT event_id AS id, event_type AS summary, (event_id % 10)::DOUBLE / 10 AS confidence FROM events""")
def _(t):
    text = F.concat(F.lit('{"summary": "'), "event_type", F.lit('", "score" : '), F.lit("0."), (F.col("event_id") % 10).cast("string"), F.lit(', "rest": ['))
    return t.events.select(F.col("event_id").alias("id"), j.partial_text(text, "summary").alias("summary"), j.partial_number(text, "confidence|score").alias("confidence"))


def loose_json():
    """JSON values of eight shapes: a text, objects with one or no usual field, nested ones, a list, a number, a boolean, null."""
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    shapes = (F.format_string('"%s"', kind), F.format_string('{"x": 1, "text": "%s", "message": ""}', kind), F.format_string('{"summary": "s", "message": {"value": ["%s", "", "b"]}}', kind), F.format_string('{"x": "%s", "y": [], "z": %s}', kind, user), F.format_string('["%s", null, {"reason": "r"}, %s]', kind, user), user, F.lit("true"), F.lit("null"))
    out = F.lit(None).cast("string")
    for i, shape in enumerate(shapes):
        out = F.when(F.col("event_id") % 9 == i, shape).otherwise(out)
    return out


@query("j6_any_to_text", """SELECT event_id AS id, CASE event_id % 9 WHEN 0 THEN event_type WHEN 1 THEN event_type WHEN 2 THEN concat(event_type, ' b') WHEN 3 THEN concat(event_type, CASE WHEN user_id <> 0 THEN concat(' ', user_id) ELSE '' END) WHEN 4 THEN concat(event_type, ' r', CASE WHEN user_id <> 0 THEN concat(' ', user_id) ELSE '' END)
    WHEN 5 THEN user_id::VARCHAR WHEN 6 THEN 'True' WHEN 7 THEN '' END AS text FROM events""")
def _(t):
    return t.events.select(F.col("event_id").alias("id"), j.as_text(loose_json()).alias("text"))


@query("j6_any_to_texts", """SELECT event_id AS id, CASE event_id % 9 WHEN 0 THEN event_type WHEN 1 THEN concat('1|', event_type) WHEN 2 THEN concat('s|', event_type, ' b') WHEN 3 THEN concat(event_type, CASE WHEN user_id <> 0 THEN concat('|', user_id) ELSE '' END) WHEN 4 THEN concat(event_type, '|r', CASE WHEN user_id <> 0 THEN concat('|', user_id) ELSE '' END)
    WHEN 5 THEN user_id::VARCHAR WHEN 6 THEN 'True' WHEN 7 THEN '' END AS texts FROM events""")
def _(t):
    return t.events.select(F.col("event_id").alias("id"), F.array_join(j.as_texts(loose_json()), "|").alias("texts"))


RELATIONS["loose"] = """SELECT event_id AS id, CASE event_id % 9 WHEN 0 THEN 'Very High' WHEN 1 THEN ' low ' WHEN 2 THEN 'none' WHEN 3 THEN '7' WHEN 4 THEN '0.4' WHEN 5 THEN 'junk' WHEN 6 THEN 'Yes' WHEN 7 THEN '12.9' ELSE 'passed' END AS v FROM events"""


@query("j7_scores", "SELECT id, CASE id % 9 WHEN 0 THEN 0.95::DOUBLE WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 0.1::DOUBLE WHEN 3 THEN 0.7::DOUBLE WHEN 4 THEN 0.4::DOUBLE WHEN 7 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM {loose} l")
def _(t):
    return t.loose.select("id", j.score(F.col("v")).alias("score"))


@query("j8_whole_and_truth", "SELECT id, trunc(try_cast(trim(v) AS DOUBLE))::BIGINT AS whole, v IS NULL OR lower(trim(v)) IN ('true', 'yes', '1', 'on', 'required', 'y') AS truth FROM (SELECT id, CASE WHEN v <> 'junk' THEN v END AS v FROM {loose} l) n")
def _(t):
    v = F.when(F.col("v") != "junk", F.col("v"))
    return t.loose.select("id", j.whole(v).alias("whole"), j.truth(v).alias("truth"))


@query("j8_json_values", """SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN user_id WHEN 1 THEN event_id % 8 WHEN 2 THEN user_id WHEN 3 THEN 1 END AS whole, CASE event_id % 5 WHEN 1 THEN false WHEN 2 THEN event_id % 2 = 0 ELSE true END AS truth,
    CASE event_id % 5 WHEN 0 THEN least(1.0, CASE WHEN user_id > 1 THEN user_id / 10.0 ELSE user_id END) WHEN 1 THEN 0.85 WHEN 2 THEN least(1.0, CASE WHEN user_id > 1 THEN user_id / 10.0 ELSE user_id END) WHEN 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM events""")
def _(t):
    user, n = F.col("user_id").cast("string"), F.col("event_id") % 5
    json = F.when(n == 0, F.concat(F.lit("["), user, F.lit(".0, 7]"))).when(n == 1, F.concat(F.lit('{"score": "High", "line": "'), (F.col("event_id") % 8).cast("string"), F.lit('.5", "required": "no"}')))
    json = json.when(n == 2, F.concat(F.lit('{"rating": '), user, F.lit(', "number": '), user, F.lit(', "enabled": '), F.when(F.col("event_id") % 2 == 0, "true").otherwise("false"), F.lit("}"))).when(n == 3, "true").otherwise("null")
    return t.events.select(F.col("event_id").alias("id"), j.json_whole(json).alias("whole"), j.json_truth(json).alias("truth"), j.json_score(json).alias("score"))


@query("j9_status", "SELECT id, CASE WHEN v = 'passed' THEN 'pass' ELSE 'warning' END AS status FROM {loose} l")
def _(t):
    return t.loose.select("id", j.status(F.col("v")).alias("status"))


@query("j10_swapped_names", """SELECT p_partkey AS seq, CASE p_size % 5 WHEN 0 THEN '*args' WHEN 1 THEN replace(p_brand, '#', '_') WHEN 2 THEN split_part(p_name, ' ', 1) WHEN 3 THEN 'param3' ELSE concat('_', p_size) END AS name,
    CASE p_size % 5 WHEN 0 THEN p_type WHEN 1 THEN p_name || ' !' WHEN 2 THEN p_name || ' !' WHEN 3 THEN '#1' ELSE '' END AS description FROM part""")
def _(t):
    n, size = F.col("p_size") % 5, F.col("p_size").cast("string")
    said = F.concat("p_name", F.lit(" !"))
    name = F.when(n == 0, "*args").when(n == 1, said).when(n == 2, said).when(n == 3, "#1").otherwise(F.concat(F.lit("_"), size))
    description = F.when(n == 0, F.col("p_type")).when(n == 1, F.concat(F.translate("p_brand", "#", "_"), F.lit(" is it"))).when(n == 2, F.lit("(the part)")).when(n == 3, F.lit("!"))
    a, b = j.swapped(name, description, F.lit(2))
    return t.part.select(F.col("p_partkey").alias("seq"), a.alias("name"), b.alias("description"))


@query("j11_clean_refs", "SELECT l_orderkey AS id, concat('p', l_partkey) AS component_id, CASE WHEN l_linenumber - 3 >= 1 THEN l_linenumber - 3 END AS line, CASE l_returnflag WHEN 'A' THEN 'exception' ELSE 'direct' END AS call_type FROM lineitem WHERE l_linestatus = 'F'")
def _(t):
    ref = F.struct(F.when(F.col("l_linestatus") == "F", F.concat(F.lit(" p"), "l_partkey")).otherwise(" ").alias("component_id"), (F.col("l_linenumber") - 3).alias("line"), F.when(F.col("l_returnflag") == "A", "Exception").otherwise("recursive").alias("call_type"))
    return t.lineitem.select(F.col("l_orderkey").alias("id"), F.explode(j.clean_refs(F.array(ref))).alias("r")).select("id", "r.*")


@query("j11_json_refs", """SELECT l_orderkey AS id, concat('p', l_partkey) AS component_id, CASE WHEN l_linenumber > 3 THEN l_linenumber::BIGINT - 3 END AS line, CASE l_returnflag WHEN 'A' THEN 'exception' ELSE 'direct' END AS call_type FROM lineitem
    UNION ALL SELECT l_orderkey, concat('s', l_suppkey), NULL, 'direct' FROM lineitem UNION ALL SELECT l_orderkey, concat('n', l_partkey), l_linenumber::BIGINT, 'direct' FROM lineitem WHERE l_linestatus = 'F'""")
def _(t):
    kind = F.when(F.col("l_returnflag") == "A", "Exception").otherwise("recursive")
    plain = F.format_string('{"component_id": " p%d", "call_site_line": "%d.0", "call_type": "%s"}, " s%d ", " ", {"component_id": null}', "l_partkey", F.col("l_linenumber") - 3, kind, "l_suppkey")
    nested = F.when(F.col("l_linestatus") == "F", F.format_string(', {"component_id": {"id": 0, "name": "n%d"}, "call_site_line": {"line": %d}}', "l_partkey", "l_linenumber")).otherwise("")
    return t.lineitem.select(F.col("l_orderkey").alias("id"), F.explode(j.json_refs(F.concat(F.lit("["), plain, nested, F.lit("]")))).alias("r")).select("id", "r.*")
