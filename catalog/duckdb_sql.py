"""The same results as the registered queries, in SQL for DuckDB."""

from __future__ import annotations

from . import derived as D

SQL: dict[str, str] = {}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# White space in RE2's terms, and the characters for trim.
WS = r"\p{Z}\t\n\x0B\f\r\x1C-\x1F\x{85}"
TRIM = "concat(chr(9),chr(10),chr(11),chr(12),chr(13),chr(28),chr(29),chr(30),chr(31),chr(32),chr(133),chr(160)," + \
    "chr(5760)," + ",".join(f"chr({c})" for c in range(0x2000, 0x200B)) + ",chr(8232),chr(8233),chr(8239),chr(8287),chr(12288))"
NL = "chr(10)"

CODED = f"SELECT doc_id, translate(text, {_q(D.PLAIN)}, {_q(D.CODED)}) AS text FROM documents"
# the coded text with only some of the steps undone
_LETTERS = (D.PLAIN[:9], D.CODED[:9], D.NORMAL[:9])


def _normal(column: str) -> str:
    return f"translate(replace(replace({column}, 'h', ''), 'd', ''), {_q(D.PLAIN[:9])}, {_q(_LETTERS[2])})"


def _unnest(table: str, key: str, text: str = "text") -> str:
    return (
        f"SELECT {key}, CAST(unnest(range(len(string_split({text}, {NL})))) AS INTEGER) AS pos, "
        f"unnest(string_split({text}, {NL})) AS text FROM {table}"
    )


LINES = _unnest("documents", "doc_id")
_PHRASES = "[" + ", ".join(map(_q, D.PHRASES)) + "]"


def _time(second: str, mark: str) -> str:
    s = f"CAST({second} AS BIGINT)"
    return f"printf('%02d:%02d:%02d{mark}000', ({s} // 3600) % 100, ({s} // 60) % 60, {s} % 60)"


CUES = f"""SELECT 'doc-' || doc_id || '.srt' AS path, 'srt' AS format, pos, CAST(pos + 1 AS VARCHAR) AS cue_index,
  {_time('pos * 2', ',')} AS start, {_time('pos * 2 + 1', ',')} AS "end",
  text || ' ' || {_PHRASES}[1 + (doc_id * 7 + pos) % {len(D.PHRASES)}] AS text FROM ({LINES})"""

# The rules of ``cuewright/rules`` in RE2, which has no look-around and whose \b knows ASCII only; so they stand
# here once more, without their word boundaries, which are added below.
W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"
S = f"[{WS}]"
NS = r"[^\p{Z}\t\n\x0B\f\r\x1C-\x1F\x{85}]"
_WORD_RULES = [
    r"([A-Za-z0-9-]+\.)+(com|ir|org|net|in|co|us|me|app|tv|xyz|info|online)",
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}",
    rf"(like|share|subscribe|follow){S}*(and|&)?{S}*(like|share|subscribe|follow)?",
    rf"join{S}+(us|our|my|the)", rf"check{S}+out", rf"click{S}+(the{S}+)?link", rf"visit{S}+(us|our|my)",
    "donate", "patreon", rf"(free{S}+)?download", rf"buy{S}+now", "(sponsor|advertisement|promo|ad|advert)",
    rf"(subtitle|sub|translat)(ed|ion)?{S}*by", rf"powered{S}+by",
    "(subscene|opensubtitles|yifysubtitles|subdl|subtitlecat|tvsubtitles)",
]
_PLAIN_RULES = [
    f"https?://{NS}", rf"www\.{NS}", f"@{W}{{2,}}", rf"t\.me/{NS}", "telegram", f"discord\\.gg/{NS}", f"instagram\\.com/{NS}",
    f"twitter\\.com/{NS}", f"youtube\\.com/{NS}", f"fb\\.com/{NS}", "whatsapp", "دانلود", "زیرنویس", "ترجمه", "تلگرام",
    "اینستاگرام", "سابسین", "سابتایتل", "خرید", "تبلیغ", "حمایت", f"لایک{S}*و?{S}*فالو", f"عضویت{S}*در{S}*کانال",
    f"آدرس{S}*(سایت|وب)", f"با{S}*کلیک{S}*روی{S}*لینک", f"کد{S}*تخفیف",
    f"تقدیم{S}*می{S}*کند", f"دنبال{S}*کنید", f"کاری{S}*از", f"تی{S}*وی", "فیلم", "مووی", "زر", "۳۰نما", "30nama",
    "CinamaSub", "مترجم",
]
FULL = f"(?i)(^|{NW})({'|'.join(_WORD_RULES)})({NW}|$)|{'|'.join(_PLAIN_RULES)}"
LITE = f"(?i)(^|{NW})(sponsor|advertisement|promo|ad|advert)({NW}|$)|https?://{NS}|t\\.me/{NS}|telegram|" \
    f"کانال{S}*تلگرام|دانلود|زیرنویس|مترجم"
FOLD = (_q("يكةؤإأآىٱ"), _q("یکهوااایا"))
_DELETED = r"[\x{200B}-\x{200F}\x{2060}-\x{2069}\x{FEFF}\x{AD}\x{64B}-\x{652}\x{670}]"


def _norm(column: str = "text", aggressive: bool = False) -> str:
    done = f"translate(regexp_replace({column}, '{_DELETED}', '', 'g'), {FOLD[0]}, {FOLD[1]})"
    return f"regexp_replace({done}, '[^\\p{{L}}{WS}]', '', 'g')" if aggressive else done


def _is_ad(rules: str = FULL, column: str = "text", aggressive: bool = False) -> str:
    return f"regexp_matches({_norm(column, aggressive)}, {_q(rules)})"


FLAGGED = f"SELECT * FROM ({CUES}) WHERE {_is_ad()}"
BASE = "regexp_extract(path, '[^/]*$')"

# ---- text functions

SQL["doc_ads"] = f"""SELECT d.doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER ({_is_ad(column='l.text')}) AS INTEGER) AS n_ads
  FROM documents d JOIN ({LINES}) l ON l.doc_id = d.doc_id GROUP BY d.doc_id"""
SQL["strip_invisible"] = f"SELECT doc_id, replace(text, chr(8204), '') AS text FROM ({CODED})"
SQL["strip_diacritics"] = f"SELECT doc_id, replace(text, chr(1614), '') AS text FROM ({CODED})"
SQL["fold_letters"] = f"SELECT doc_id, translate(text, {_q(_LETTERS[1])}, {_q(_LETTERS[2])}) AS text FROM ({CODED})"
SQL["nfkc"] = f"SELECT doc_id, translate(text, {_q(D.CODED[9:35])}, {_q(D.PLAIN[9:35])}) AS text FROM ({CODED})"
SQL["letters_only"] = f"SELECT doc_id, regexp_replace(text, '[^\\p{{L}}{WS}]', '', 'g') AS text FROM documents"
SQL["normalize_lines"] = f"SELECT doc_id, pos, {_normal('text')} AS text FROM ({LINES})"
SQL["normalize_aggressive"] = f"SELECT doc_id, regexp_replace({_normal('text')}, '[^\\p{{L}}{WS}]', '', 'g') AS text FROM documents"
SQL["clean_tags_pages"] = f"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '\\{{[^}}]+\\}}', '', 'g'),
  '<[^>]+>', '', 'g'), '[{WS}]+', ' ', 'g'), {TRIM}) AS text FROM pages"""
SQL["safe_filename"] = f"""SELECT page_id, trim(translate(url, '\\/*?:"<>|', '_________'), {TRIM}) AS name FROM pages"""
SQL["url_filenames"] = """SELECT page_id, CASE WHEN name <> '' THEN name ELSE page_id || '_farsi_s1.zip' END AS file_name FROM (
  SELECT page_id, regexp_extract(regexp_extract(url || CASE WHEN page_id % 2 = 0 THEN '/' ELSE '' END,
    '^[a-z]+://[^/?#]*([^?#;]*)', 1), '[^/]*$') AS name FROM pages)"""

# ---- reading subtitles

_FILE_LINES = f"""SELECT 'subs/' || source || '/doc-' || doc_id AS stem, doc_id,
    CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS pos, text
  FROM ({_unnest('documents', 'doc_id, source')}) WHERE trim(text, {TRIM}) <> ''"""
# trailing white space of a block's last line goes with the block's
_TEXT = f"rtrim(text, {TRIM})"
SRT_CUES = f"""SELECT stem || '.srt' AS path, doc_id, 'srt' AS format, pos, CAST(pos + 1 AS VARCHAR) AS cue_index,
  {_time('pos * 2', ',')} AS start, {_time('pos * 2 + 1', ',')} AS "end", {_TEXT} AS text FROM ({_FILE_LINES})"""
VTT_CUES = f"""SELECT stem || '.vtt' AS path, 'vtt' AS format, pos,
  CASE WHEN pos % 2 = 0 THEN CAST(pos + 1 AS VARCHAR) ELSE '' END AS cue_index,
  {_time('pos * 2', '.')} AS start, {_time('pos * 2 + 1', '.')} AS "end", {_TEXT} AS text FROM ({_FILE_LINES})"""
_ASS_PLAIN = f"replace(replace(replace(regexp_replace(text, '\\{{[^}}]*\\}}', '', 'g'), '\\h', ' '), '\\n', {NL}), '\\N', {NL})"
SQL["cue_times"] = f"SELECT path, pos, CAST(pos AS BIGINT) * 2000 AS start_ms, CAST(pos AS BIGINT) * 2000 + 1000 AS end_ms, CAST(1000 AS BIGINT) AS duration_ms FROM ({SRT_CUES})"
SQL["display_cols"] = f"""SELECT path, pos, path AS file, cue_index, start || ' --> ' || "end" AS time, text FROM ({CUES})"""
SQL["decode_files"] = """SELECT 'd/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.VTT' WHEN 1 THEN '.ssa' ELSE '.txt' END AS path,
  CASE doc_id % 3 WHEN 0 THEN 'vtt' WHEN 1 THEN 'ass' ELSE 'srt' END AS format, text || chr(65533) AS content FROM documents"""
SQL["srt_parse"] = f"SELECT * EXCLUDE (doc_id) FROM ({SRT_CUES})"
SQL["vtt_parse"] = VTT_CUES
SQL["ass_parse"] = f"""SELECT stem || '.ass' AS path, 'ass' AS format, pos, CAST(pos + 1 AS VARCHAR) AS cue_index,
  CAST(CAST(pos AS BIGINT) * 1000 + 500 AS VARCHAR) AS start, CAST(CAST(pos AS BIGINT) * 1000 + 1500 AS VARCHAR) AS "end",
  {_ASS_PLAIN} || {NL} || 'end' AS text FROM ({_FILE_LINES})"""
SQL["load_batch"] = f"SELECT 2 * (SELECT count(*) FROM documents) AS files, 2 * count(*) AS cues FROM ({_FILE_LINES})"
SQL["load_batch_table"] = f"""WITH c AS (SELECT doc_id, count(*) AS n, max_by(text, pos) AS text FROM ({_FILE_LINES}) GROUP BY doc_id)
  SELECT 'subs/' || source || '/doc-' || doc_id || '.' || format AS path, format, CAST(coalesce(n, 0) AS INTEGER) AS n_cues, rtrim(c.text, {TRIM}) AS last_text
  FROM documents LEFT JOIN c USING (doc_id), (VALUES ('srt'), ('vtt')) v(format)"""
SQL["read_lines"] = f"SELECT trim(text, {TRIM}) AS text FROM ({LINES}) WHERE trim(text, {TRIM}) <> ''"
SQL["merge_texts"] = f"""SELECT 'd/' || doc_id || '.txt' AS path, trim(regexp_replace(regexp_replace(regexp_replace(text,
  '\\{{[^}}]+\\}}', '', 'g'), '<[^>]+>', '', 'g'), '[{WS}]+', ' ', 'g'), {TRIM}) AS text FROM documents"""
SQL["text_corpus"] = f"SELECT substr(path, 3) AS name, text FROM ({SQL['merge_texts']})"
SQL["dropped_chunks"] = f"""SELECT CAST(doc_id AS VARCHAR) AS path, CAST(len(list_filter(
  string_split_regex(text, '\\n[{WS}]*\\n'), lambda b: trim(b, {TRIM}) <> '')) AS INTEGER) AS dropped FROM documents"""
_MEMBERS = """SELECT 'root/' || CASE WHEN (doc_id // 5) % 3 = 0 THEN 'english' ELSE 'Farsi' END || printf('/part-%08d.ZIP', doc_id // 5) AS archive,
  doc_id // 5 AS number, CAST(row_number() OVER (PARTITION BY doc_id // 5 ORDER BY doc_id) AS INTEGER) AS ordinal,
  source || '-' || doc_id % 50 || '.txt' AS name, text AS content FROM documents"""
SQL["archive_members"] = f"""SELECT archive, ordinal, name, content FROM ({_MEMBERS}) WHERE number % 3 <> 0 AND number % 10 <> 9
  QUALIFY row_number() OVER (PARTITION BY name ORDER BY archive, ordinal) = 1"""
SQL["archive_errors"] = f"SELECT DISTINCT archive FROM ({_MEMBERS}) WHERE number % 3 <> 0 AND number % 10 = 9"
SQL["extract_archives"] = SQL["archive_members"]
SQL["extract_errors"] = SQL["archive_errors"]
SQL["read_archives"] = f"SELECT archive, ordinal, name, content FROM ({_MEMBERS}) WHERE number % 3 <> 0 AND number % 10 <> 9"
_ANCHORS = """SELECT page_id, url, CAST(unnest(range(len(h))) AS INTEGER) AS pos, unnest(h) AS href, unnest(t) AS text FROM (
  SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)">(.*?)</a>', 1) AS h,
    regexp_extract_all(html, '<a href="([^"]*)">(.*?)</a>', 2) AS t FROM pages)"""
_ORIGIN = "regexp_extract(url, '^[a-z]+://[^/?#]*')"
SQL["extract_links"] = f"SELECT page_id, pos, text, {_ORIGIN} || href AS url FROM ({_ANCHORS})"
SQL["catalogue_links"] = f"""SELECT page_id, pos, CASE WHEN pos % 3 = 0 THEN 'Unknown' ELSE 'No ' || pos END AS text,
  {_ORIGIN} || href AS url FROM ({_ANCHORS})"""
_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_FOLDER = f"regexp_replace({_PATH}, '[^/]*$', '')"
_UP = f"CASE WHEN length({_FOLDER}) > 1 THEN regexp_replace({_FOLDER}, '[^/]*/$', '') ELSE '/' END"
SQL["absolute_urls"] = f"""SELECT page_id, CAST(unnest(range(7)) AS INTEGER) AS pos, unnest([
  {_ORIGIN} || '/a/' || page_id, {_ORIGIN} || {_FOLDER} || 'b' || page_id, {_ORIGIN} || ({_UP}) || 'c' || page_id,
  regexp_extract(url, '^[^?#]*') || '?d=' || page_id, regexp_extract(url, '^[^#]*') || '#e' || page_id,
  regexp_extract(url, '^[a-z]+:') || '//h.net/' || page_id, 'https://i.org/' || page_id]) AS url FROM pages"""
SQL["extract_downloads"] = """WITH a AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages),
  l AS (SELECT page_id, CAST(ceil(len(h) / 3) AS BIGINT) AS third, unnest(range(len(h))) AS i, unnest(h) AS href FROM a),
  d AS (SELECT page_id, i, href, CASE WHEN i < third THEN 'english' WHEN i < 2 * third THEN 'arabic' ELSE 'farsi' END AS lang FROM l),
  s AS (SELECT page_id, i, lang, CASE WHEN i < 2 THEN 'unknown' ELSE 'Season_' || (i - i % 2) END AS season,
    'http://h.org' || href || '.zip?x=1' AS url, regexp_extract(href, '[^/]*$') || '.zip' AS file_name FROM d WHERE lang <> 'arabic')
  SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS pos, lang, season, url, file_name FROM s"""

# ---- detection

SQL["detect_full"] = f"SELECT doc_id, pos, text FROM ({LINES}) WHERE {_is_ad()}"
SQL["detect_planted"] = f"SELECT path, pos, text FROM ({FLAGGED})"
SQL["detect_lite"] = f"SELECT path, pos, text FROM ({CUES}) WHERE {_is_ad(LITE)}"
SQL["detect_aggressive"] = f"SELECT path, pos, text FROM ({CUES}) WHERE {_is_ad(aggressive=True)}"
SQL["detect_conversations"] = f"""SELECT * FROM (SELECT conv_id, turn, text || ' ' || {_PHRASES}[1 + (conv_id * 7 + turn) % {len(D.PHRASES)}] AS text
  FROM conversations) WHERE {_is_ad()}"""
SQL["keyword_filter"] = f"SELECT doc_id, pos, text FROM ({LINES}) WHERE contains(lower(text), 'the')"
SQL["min_length"] = f"SELECT doc_id, pos, text AS clean_text FROM ({LINES}) WHERE length(text) >= 15"

# ---- actions and writing

_HIT = _is_ad()
SQL["remove_ads"] = f"SELECT path, pos, text FROM ({CUES}) WHERE NOT ({_HIT} AND pos % 2 = 0)"
SQL["replace_fixed"] = f"SELECT path, pos, CASE WHEN {_HIT} AND pos % 2 = 0 THEN '(removed)' ELSE text END AS text FROM ({CUES})"
SQL["replace_random"] = f"SELECT path, pos, {_HIT} AS drawn, CASE WHEN NOT {_HIT} THEN text END AS text FROM ({CUES})"
SQL["apply_edits"] = f"SELECT path, pos, CASE WHEN pos % 5 = 0 THEN 'edited: ' || text ELSE text END AS text FROM ({CUES})"
SQL["only_decided"] = f"SELECT path, pos, text FROM ({FLAGGED}) WHERE pos % 2 = 0"
SQL["skip_existing"] = "SELECT doc_id, source || '-' || doc_id AS name FROM documents WHERE doc_id % 3 <> 0"
SQL["clean_list"] = SQL["detect_planted"]
SQL["clean_remove"] = f"SELECT path, pos, text FROM ({CUES}) WHERE NOT {_HIT}"
SQL["clean_replace"] = f"SELECT path, pos, CASE WHEN {_HIT} THEN '-' ELSE text END AS text FROM ({CUES})"


def _srt_content(cues: str) -> str:
    piece = f"""cue_index || {NL} || start || ' --> ' || "end" || {NL} || text || {NL}"""
    return f"SELECT path, string_agg({piece}, {NL} ORDER BY pos) AS content FROM ({cues}) GROUP BY path"


_DOC_PATHS = "SELECT 'subs/' || source || '/doc-' || doc_id AS stem FROM documents"
SQL["srt_roundtrip"] = f"""SELECT stem || '.srt' AS path, 'srt' AS format, coalesce(content, '') AS content
  FROM ({_DOC_PATHS}) LEFT JOIN ({_srt_content(SRT_CUES)}) ON path = stem || '.srt'"""
SQL["vtt_rebuild"] = f"""SELECT stem || '.vtt' AS path, 'vtt' AS format, 'WEBVTT' || {NL} || coalesce(content, '') AS content
  FROM ({_DOC_PATHS}) LEFT JOIN (SELECT path, string_agg({NL} || CASE WHEN cue_index <> '' THEN cue_index || {NL} ELSE '' END
    || start || ' --> ' || "end" || {NL} || text || {NL}, '' ORDER BY pos) AS content FROM ({VTT_CUES}) GROUP BY path) ON path = stem || '.vtt'"""
_ASS_TIME = lambda s: f"printf('%d:%02d:%02d.50', (CAST({s} AS BIGINT) // 3600) % 10, (CAST({s} AS BIGINT) // 60) % 60, CAST({s} AS BIGINT) % 60)"
_ASS_HEAD = """[Script Info]
ScriptType: v4.00+
WrapStyle: 0
ScaledBorderAndShadow: yes
Collisions: Normal

[V4+ Styles]
Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding
Style: Default,Arial,20,&H00FFFFFF,&H000000FF,&H00000000,&H00000000,0,0,0,0,100,100,0,0,1,2,2,2,10,10,10,1

[Events]
Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text
"""
SQL["ass_rebuild"] = f"""SELECT stem || '.ass' AS path, 'ass' AS format, {_q(_ASS_HEAD)} || coalesce(content, '') AS content
  FROM ({_DOC_PATHS}) LEFT JOIN (SELECT stem AS s, string_agg(CASE WHEN pos % 2 = 0 THEN 'Dialogue' ELSE 'Comment' END || ': 0,'
    || {_ASS_TIME('pos')} || ',' || {_ASS_TIME('pos + 1')} || ',Default,,0,0,0,,' || CASE WHEN pos % 2 = 0 THEN '{{\\an8}}' ELSE '' END
    || text || '\\Nend' || {NL}, '' ORDER BY pos) AS content FROM ({_FILE_LINES}) GROUP BY stem) ON s = stem"""
SQL["rebuild_parts"] = SQL["srt_roundtrip"]
_PLANTED = f"""SELECT path, doc_id, pos, cue_index, start, "end", line || ' ' || {_PHRASES}[1 + (doc_id * 7 + pos) % {len(D.PHRASES)}] AS text
  FROM (SELECT stem || '.srt' AS path, doc_id, pos, CAST(pos + 1 AS VARCHAR) AS cue_index, {_time('pos * 2', ',')} AS start,
    {_time('pos * 2 + 1', ',')} AS "end", text AS line FROM ({_FILE_LINES}))"""
_CLEANED = f"""SELECT stem || '.srt' AS path, 'srt' AS format, coalesce(content, '') AS content
  FROM ({_DOC_PATHS}) LEFT JOIN ({_srt_content(f'SELECT * FROM ({_PLANTED}) WHERE NOT {_HIT}')}) ON path = stem || '.srt'"""
SQL["clean_srt_files"] = f"SELECT *, 'out/' || regexp_extract(path, '([^/]*)\\.srt$', 1) || '_clean.srt' AS out_path FROM ({_CLEANED})"
SQL["clean_stream"] = f"SELECT {BASE} AS name, content FROM ({_CLEANED})"
SQL["written_files"] = f"""SELECT regexp_extract(stem, '([^/]*)$', 1) || '_clean.srt' AS name, 'srt' AS format, coalesce(content, '') AS content
  FROM ({_DOC_PATHS}) LEFT JOIN ({_srt_content(f"SELECT * FROM ({SRT_CUES}) WHERE path NOT LIKE '%7.srt'")}) ON path = stem || '.srt'"""
SQL["committed_files"] = SQL["written_files"]
SQL["output_names"] = """SELECT 'in/' || source || '/v1.' || doc_id || '.srt' AS path,
  'in/' || source || '/v1.' || doc_id || '_clean.srt' AS out_path FROM documents"""
SQL["ad_report"] = f"""WITH f AS ({FLAGGED}), last AS (SELECT path, max(pos) AS pos FROM f GROUP BY path)
  SELECT path, path AS file, pos, CAST(0 AS INTEGER) AS line_no, 'Index: ' || cue_index || ' | Time: ' || start || ' --> ' || "end" AS line FROM f
  UNION ALL SELECT path, path, pos, 1, 'Text: ' || text FROM f UNION ALL SELECT path, path, pos, 2, '' FROM f
  UNION ALL SELECT path, path, -1, 0, '--- File: ' || path || ' ---' FROM last UNION ALL SELECT path, path, pos, 2147483647, '' FROM last"""
SQL["ad_report_console"] = f"""WITH f AS ({FLAGGED})
  SELECT path, path AS file, pos, CAST(0 AS INTEGER) AS line_no, path || ': block ' || cue_index || ' [' || start || ' --> ' || "end" || ']' AS line FROM f
  UNION ALL SELECT path, path, pos, 1, '    ' || text FROM f UNION ALL SELECT path, path, pos, 2, '' FROM f"""

# ---- counts and samples

SQL["batch_stats"] = f"""SELECT count(DISTINCT path) AS files, count(*) AS cues, count(*) FILTER (ad) AS flagged,
  count(*) FILTER (ad AND pos % 2 = 0) AS selected FROM (SELECT path, pos, {_HIT} AS ad FROM ({CUES}))"""
SQL["batch_totals"] = f"""SELECT (SELECT count(*) FROM documents) AS files, count(*) AS cues, count(*) FILTER ({_HIT}) AS flagged
  FROM ({_PLANTED})"""
SQL["ads_per_file"] = f"SELECT path, count(*) AS n_ads, min(pos) AS first_pos, max(pos) AS last_pos FROM ({FLAGGED}) GROUP BY path"
SQL["ad_positions"] = f"""SELECT path, CAST(pos // 16 AS INTEGER) AS part, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions
  FROM ({FLAGGED}) GROUP BY path, pos // 16"""
SQL["dedup_text"] = f"SELECT DISTINCT text AS clean_text FROM ({LINES})"


def _dataset(texts: str, label: int) -> str:
    return f"SELECT DISTINCT {_norm()} AS clean_text, CAST({label} AS INTEGER) AS label FROM ({texts}) WHERE length({_norm()}) >= 15"


SQL["build_dataset"] = _dataset(SQL["read_lines"], 1)
SQL["dataset_csv"] = _dataset(LINES, 1)
_BOTH = f"{_dataset(FLAGGED, 1)} UNION ALL {_dataset(LINES, 0)}"
SQL["union_datasets"] = _BOTH
SQL["class_counts"] = f"SELECT label, count(*) AS n FROM ({_BOTH}) GROUP BY label"
SQL["shuffle_samples"] = _BOTH
SQL["stratified_split_exact"] = f"SELECT label, count(*) AS n, CAST(round(count(*) * 0.2) AS BIGINT) AS n_test FROM ({_BOTH}) GROUP BY label"
SQL["stratified_split"] = f"""SELECT clean_text, label, CAST('0x' || substr(md5('42|' || clean_text), 1, 10) AS BIGINT) < {int(0.2 * 2**40)} AS is_test
  FROM ({_BOTH})"""

# ---- classifier


def _grams(source: str, key: str, lo: int, hi: int) -> str:
    sizes = " UNION ALL ".join(
        f"SELECT {key}, substr(t, CAST(i AS BIGINT), {n}) AS gram FROM (SELECT {key}, t, unnest(range(1, length(t) - {n} + 2)) AS i FROM p)"
        for n in range(lo, hi + 1)
    )
    return f"WITH p AS (SELECT {key}, regexp_replace(lower(text), '[{WS}]{{2,}}', ' ', 'g') AS t FROM ({source})) {sizes}"


_COUNTS = f"SELECT gram, count(*) AS n FROM ({_grams(LINES, 'doc_id', 3, 4)}) GROUP BY gram"
SQL["char_ngram_counts"] = _COUNTS
SQL["vocabulary"] = f"SELECT gram, n FROM ({_COUNTS}) ORDER BY n DESC, gram LIMIT 2000"
_TURNS = "SELECT conv_id || '-' || turn AS id, text FROM conversations"


def _tfidf(hi: int, tf: str) -> str:
    return f"""WITH g AS (SELECT id, gram, count(*) AS tf FROM ({_grams(_TURNS, 'id', 3, hi)}) GROUP BY id, gram),
  d AS (SELECT gram, count(*) AS df FROM g GROUP BY gram),
  w AS (SELECT id, gram, {tf} * (ln((1 + (SELECT count(*) FROM conversations)) / (1 + df)) + 1) AS w FROM g JOIN d USING (gram)),
  n AS (SELECT id, sqrt(sum(w * w)) AS norm FROM w GROUP BY id)
  SELECT id, gram, round(w / norm, 6) AS weight FROM w JOIN n USING (id)"""


SQL["gram_dictionary"] = f"""SELECT gram, n, df, row_number() OVER (ORDER BY n DESC, gram) - 1 AS idx FROM (
  SELECT gram, count(*) AS n, count(DISTINCT doc_id) AS df FROM ({_grams('SELECT doc_id, text FROM documents', 'doc_id', 3, 4)}) GROUP BY gram)"""
SQL["fold_dictionary"] = f"""WITH c AS ({_grams('SELECT doc_id, text FROM documents', 'doc_id', 3, 3)}),
  f AS (SELECT k AS fold, gram, count(*) AS n, count(DISTINCT doc_id) AS df FROM c, (SELECT unnest(range(3)) AS k) WHERE doc_id % 3 <> k GROUP BY ALL)
  SELECT CAST(fold AS INTEGER) AS fold, gram, n, df, row_number() OVER (PARTITION BY fold ORDER BY n DESC, gram) - 1 AS idx FROM f
  QUALIFY row_number() OVER (PARTITION BY fold ORDER BY n DESC, gram) <= 2000"""
SQL["tfidf_weights"] = _tfidf(4, "tf")
SQL["tfidf_sublinear"] = _tfidf(3, "(1 + ln(tf))")
_LABELLED = "SELECT documents.doc_id, text, quality FROM documents JOIN labels USING (doc_id)"


def _linear(source: str, key: str) -> str:
    """Scores by the model of fixed coefficients."""
    return f"""WITH lg AS ({_grams(_LABELLED, 'doc_id, quality', 3, 3)}),
  lc AS (SELECT doc_id, quality, gram, count(*) AS tf FROM lg GROUP BY ALL),
  m AS (SELECT gram, round(ln((1.0::DOUBLE + (SELECT count(*) FROM ({_LABELLED}))) / (1 + count(*))) + 1, 6) AS idf,
    round(ln((sum(CASE WHEN quality = 1 THEN tf ELSE 0 END) + 1.0::DOUBLE) / (sum(CASE WHEN quality = 0 THEN tf ELSE 0 END) + 1)), 6) AS coefficient
    FROM lc GROUP BY gram HAVING sum(tf) >= 20),
  tg AS ({_grams(source, key, 3, 3)}),
  w AS (SELECT {key}, count(*) * any_value(idf) AS w, any_value(coefficient) AS coefficient FROM tg JOIN m USING (gram) GROUP BY {key}, gram),
  s AS (SELECT {key}, sum(w * coefficient) / sqrt(sum(w * w)) AS dot FROM w GROUP BY {key})
  SELECT {key}, text, 1 / (1 + exp(-(-0.5 + coalesce(dot, 0)))) AS score FROM ({source}) LEFT JOIN s USING ({key})"""


_FLAGGED_LINES = _linear(LINES, "doc_id, pos")
SQL["linear_scores"] = f"SELECT id, round(score, 6) AS score FROM ({_linear(_TURNS, 'id')})"
SQL["detect_linear"] = f"SELECT doc_id, pos, text FROM ({_FLAGGED_LINES}) WHERE score >= 0.55"
SQL["clean_linear"] = f"""SELECT doc_id, count(*) FILTER (score >= 0.55) AS n_removed,
  coalesce(string_agg(text, chr(10) ORDER BY pos) FILTER (score < 0.55), '') AS text FROM ({_FLAGGED_LINES}) GROUP BY doc_id"""
_PRED = """SELECT *, CAST(score >= 0.5 AS INTEGER) AS prediction FROM (
  SELECT CAST(toxic AS INTEGER) AS label, ((doc_id * 37 + toxic * 400) % 1000) / 1000 AS score FROM labels)"""
SQL["classification_report"] = f"""WITH c AS (SELECT c, count(*) FILTER (label = c AND prediction = c) AS tp,
    count(*) FILTER (label <> c AND prediction = c) AS fp, count(*) FILTER (label = c AND prediction <> c) AS fn
    FROM ({_PRED}), (VALUES (0), (1)) v(c) GROUP BY c),
  r AS (SELECT c, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r,
    CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f, tp + fn AS s, tp FROM c),
  a AS (SELECT sum(tp) / sum(s) AS acc, CAST(sum(s) AS BIGINT) AS n FROM r),
  t AS (SELECT CAST(c AS VARCHAR) AS class, p, r, f, CAST(s AS BIGINT) AS support FROM r
  UNION ALL SELECT 'accuracy', acc, acc, acc, n FROM a
  UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), CAST(sum(s) AS BIGINT) FROM r
  UNION ALL SELECT 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f * s) / sum(s), CAST(sum(s) AS BIGINT) FROM r)
  SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support FROM t"""
SQL["confusion_matrix"] = f"""SELECT label, count(*) FILTER (prediction = 0) AS predicted_0, count(*) FILTER (prediction = 1) AS predicted_1
  FROM ({_PRED}) GROUP BY label"""
SQL["roc_auc"] = f"""WITH s AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM ({_PRED}) GROUP BY score),
  c AS (SELECT pos, neg, sum(neg) OVER (ORDER BY score) - neg AS below FROM s)
  SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 9) AS auc FROM c"""
SQL["score_curve"] = f"""SELECT score, pos, neg, CAST(sum(pos) OVER (ORDER BY score DESC) AS BIGINT) AS tp, CAST(sum(neg) OVER (ORDER BY score DESC) AS BIGINT) AS fp
  FROM (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM ({_PRED}) GROUP BY score)"""
SQL["recall_threshold"] = f"""WITH p AS ({_PRED}), t AS (SELECT quantile_disc(score, 0.05) AS a,
    list(score ORDER BY score DESC)[CAST(ceil(0.95 * count(*)) AS BIGINT)] AS threshold FROM p WHERE label = 1)
  SELECT any_value(threshold) AS threshold, round(count(*) FILTER (label = 1 AND score >= threshold) / count(*) FILTER (label = 1), 9) AS recall,
    round(count(*) FILTER (label = 1 AND score >= threshold) / count(*) FILTER (score >= threshold), 9) AS precision FROM p, t"""
