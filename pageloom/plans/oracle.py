"""DuckDB SQL with the results of the queries in catalog.py: shared parts, then one text per query."""

from __future__ import annotations

from pageloom.operators.cleanup import AFTER_TRIM, BEFORE_TRIM, Rule

WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]"
NUM = "一二三四五六七八九十百零〇○"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '{WS}', '', 'g')"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def filled(x: str) -> str:
    return f"coalesce({strip(x)} <> '', false)"


def skipped(x: str) -> str:
    return f"coalesce(lower({x}) IN ('footer', 'header', 'image', 'picture'), false)"


def overlap(new: str, old: str) -> str:
    return f"CASE WHEN length({new}) < 8 THEN CAST(contains({old}, {new}) AS DOUBLE) ELSE CAST(len(list_filter(range(1, length({new}) - 6), lambda i: contains({old}, substr({new}, i, 8)))) AS DOUBLE) / (length({new}) - 7) END"


def half_up(x: str) -> str:
    return f"CAST(floor({x} + CAST(0.5 AS DOUBLE)) AS BIGINT)"


def key(p: str = "") -> str:
    return f"concat_ws('_', {p}page, " + ", ".join(half_up(f'{p}"{x}"') for x in ("left", "bottom", "right", "top")) + ")"


def unit(x: str) -> str:
    return f"least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), {x}))"


def sha16(page: str, text: str) -> str:
    return f"sha256({page} || ':' || {text})[1:16]"


def iou(a: str, b: str) -> str:
    w = f"greatest(CAST(0 AS DOUBLE), least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x))"
    h = f"greatest(CAST(0 AS DOUBLE), least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y))"
    union = f"({a}.w * {a}.h + {b}.w * {b}.h - {w} * {h})"
    return f"CASE WHEN {w} * {h} > 0 AND {union} > 0 THEN {w} * {h} / {union} ELSE CAST(0 AS DOUBLE) END"


def fold(members: str, drop: str) -> str:
    """Members in order, without those for which drop holds against one kept before (old, new)."""
    return f"list_reduce(list_transform({members}, lambda z: [z]), lambda acc, c: CASE WHEN len(list_filter(acc, lambda o: {drop})) > 0 THEN acc ELSE list_concat(acc, c) END)"


def rewrite(rules: list[Rule], source: str, name: str) -> list[str]:
    """A part for each rule, on the one before; t is the text, k the changes."""
    out = []
    for i, r in enumerate(rules):
        quote = lambda x: "'" + x.replace("'", "''") + "'"
        new = f"replace(t, {quote(r.pattern)}, {quote(r.replacement)})" if r.literal else f"regexp_replace(t, {quote(_re2(r.pattern))}, {quote(r.replacement)}, 'g')"
        before = source if i == 0 else f"{name}{i - 1}"
        out.append(f"{name}{i} AS (SELECT * EXCLUDE (n) REPLACE (n AS t, CASE WHEN n <> t THEN list_append(k, '{r.kind}:' || n) ELSE k END AS k) FROM (SELECT *, {new} AS n FROM {before}))")
    return out


def _re2(pattern: str) -> str:
    import re

    return re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", pattern)


def phrases(rows: list[tuple[int, str, str]], stage: int, text: str) -> str:
    """The text with a stage's phrases replaced: cut into phrases (longer ones tried first) and single characters."""
    own = dict(reversed([(p, r) for n, p, r in rows if n == stage]))
    cut = "|".join(sorted(own, key=len, reverse=True))
    cases = " ".join(f"WHEN '{p}' THEN '{r}'" for p, r in own.items())
    return f"array_to_string([CASE x {cases} ELSE x END FOR x IN regexp_extract_all({text}, '(?s){cut}|.')], '')"


#: The made phrases of the query script_conversion.
PHRASES = [(0, "th", "技"), (0, "the", "技街"), (0, "an", "国"), (0, "and", "国家"), (0, "ndi", "x"), (0, "草案", "草 案"), (1, "技", "技"), (1, "家l", "家 l"), (1, "o", "ö"), (1, "on", "發")]
_SPLIT = "string_split(CASE WHEN doc_id % 47 = 5 THEN replace(text, ' ', chr(10)) ELSE text END, chr(10))"
PARTS = [
    f"ln AS (SELECT doc_id AS document_id, doc_id % 47 = 5 AS dense, unnest({_SPLIT}) AS line, unnest(range(len({_SPLIT}))) AS seq FROM documents WHERE text IS NOT NULL)",
    "geo AS (SELECT *, CASE WHEN dense THEN (seq % 40) // 8 ELSE seq % 8 END AS row_no, CAST(CASE WHEN dense THEN seq // 40 ELSE seq // 8 END + 1 AS INTEGER) AS page, length(line) AS n FROM ln)",
    """typ AS (SELECT *, CASE WHEN dense THEN 'paragraph' WHEN seq = 0 AND n <= 80 THEN 'heading' WHEN row_no = 7 AND n <= 120 THEN 'footer' WHEN (document_id + seq) % 11 = 0 THEN 'table' WHEN (document_id + seq) % 13 = 0 THEN 'list' ELSE 'paragraph' END AS type,
        CASE WHEN dense THEN CAST(72 + 60 * (seq % 8) AS DOUBLE) ELSE CAST(72 + 60 * ((document_id + seq) % 4) AS DOUBLE) - CASE WHEN document_id % 97 = 0 AND row_no = 0 THEN 100 ELSE 0 END END AS l, CAST(720 - 80 * row_no AS DOUBLE) AS t FROM geo)""",
    """box AS (SELECT document_id, seq, page, type, l, t - CAST(CASE WHEN document_id % 89 = 0 THEN 1.5 WHEN dense THEN 10 ELSE 60 END AS DOUBLE) AS b, l + least(CAST(n AS DOUBLE) * 5, CAST(CASE WHEN dense THEN 50 ELSE 288 END AS DOUBLE)) AS r, t,
        CASE WHEN document_id % 41 = 0 THEN regexp_replace(line, '[aeiou]', chr(65533), 'g') WHEN document_id % 43 = 0 THEN translate(line, 'aeiounrst', '條文說明規定備註項') WHEN document_id % 53 = 7 THEN regexp_replace(line, '(.)', '\\1   ', 'g') ELSE line END AS txt FROM typ)""",
    """items AS (SELECT document_id, CAST(pass AS INTEGER) AS pass, CAST(seq AS INTEGER) AS seq, type, page, l + dx AS "left", b AS bottom, r + dx AS "right", t AS top,
        CASE WHEN pass = 1 THEN CASE WHEN (document_id * 31 + seq) % 7 = 3 OR type = 'table' THEN NULL ELSE txt END ELSE CASE WHEN type = 'heading' THEN NULL ELSE txt END END AS content,
        CAST(CASE WHEN type = 'heading' THEN 18 ELSE 11 END AS DOUBLE) AS font_size, CASE WHEN type = 'table' THEN CASE WHEN seq % 2 = 0 THEN '[]' ELSE '[1]' END END AS rows_json
        FROM (SELECT *, CAST(CASE WHEN pass = 1 THEN 0 WHEN (document_id + seq) % 5 = 0 THEN 3 ELSE 0.2 END AS DOUBLE) AS dx FROM box, (VALUES (1), (2)) p(pass)))""",
    "infos AS (SELECT document_id, unnest(range(1, m + 2)) AS page, CAST(612 AS DOUBLE) AS pw, CAST(792 AS DOUBLE) AS ph FROM (SELECT document_id, max(page) AS m FROM box GROUP BY 1))",
    f"kd AS (SELECT *, {key()} AS key, {filled('content')} AS has FROM items)",
    "p2 AS (SELECT * FROM kd WHERE pass = 2 QUALIFY row_number() OVER (PARTITION BY document_id, key ORDER BY seq DESC) = 1)",
    """fill AS (SELECT a.document_id, a.seq, NOT a.has AND coalesce(b.has, false) AS filled, CASE WHEN NOT a.has AND coalesce(b.has, false) THEN struct_pack(type := b.type, page := b.page, l := b."left", b := b.bottom, r := b."right", t := b.top, content := b.content, font_size := b.font_size, rows_json := b.rows_json)
        ELSE struct_pack(type := a.type, page := a.page, l := a."left", b := a.bottom, r := a."right", t := a.top, content := a.content, font_size := a.font_size, rows_json := a.rows_json) END AS s FROM kd a LEFT JOIN p2 b ON a.document_id = b.document_id AND a.key = b.key WHERE a.pass = 1)""",
    f"gaps AS (SELECT DISTINCT document_id, page FROM kd WHERE pass = 1 AND NOT has AND NOT {skipped('type')})",
    """extra AS (SELECT document_id, seq, struct_pack(type := type, page := page, l := "left", b := bottom, r := "right", t := top, content := content, font_size := font_size, rows_json := rows_json) AS s FROM kd
        WHERE pass = 2 AND has AND NOT EXISTS (SELECT 1 FROM kd o WHERE o.pass = 1 AND o.document_id = kd.document_id AND o.key = kd.key) AND (document_id, page) IN (SELECT (document_id, page) FROM gaps))""",
    "pool AS (SELECT document_id, 1 AS src, seq, filled, s FROM fill UNION ALL SELECT document_id, 2, seq, false, s FROM extra)",
    f"folded AS (SELECT document_id, {fold('m', 'c[1].src = 2 AND ' + overlap('c[1].x', 'o.x') + ' >= 0.5')} AS kept FROM (SELECT document_id, list(struct_pack(src := src, seq := seq, x := lower({strip('s.content')})) ORDER BY src, seq) AS m FROM pool WHERE {filled('s.content')} AND document_id IN (SELECT document_id FROM extra) GROUP BY 1))",
    "keep2 AS (SELECT document_id, k.seq AS seq FROM (SELECT document_id, unnest(kept) AS k FROM folded) WHERE k.src = 2)",
    """merged AS (SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY s.page, s.t DESC, src, seq) - 1 AS INTEGER) AS seq, filled, s.type AS type, s.page AS page, s.l AS "left", s.b AS bottom, s.r AS "right", s.t AS top, s.content AS content, s.font_size AS font_size, s.rows_json AS rows_json
        FROM pool WHERE src = 1 OR (document_id, seq) IN (SELECT (document_id, seq) FROM keep2))""",
    f"""meas AS (SELECT i.document_id, i.page, pw, ph, m.seq, m.type, m."left" AS l, m.font_size, greatest(CAST(0 AS DOUBLE), m."right" - m."left") * greatest(CAST(0 AS DOUBLE), m.top - m.bottom) AS area,
        m."left" < -5 OR m.bottom < -5 OR m."right" > pw + 5 OR m.top > ph + 5 AS off, greatest(CAST(0 AS DOUBLE), m.top - m.bottom) > 0 AND greatest(CAST(0 AS DOUBLE), m.top - m.bottom) < 2 AS tiny,
        length({strip("coalesce(content, '')")}) AS ch, length(coalesce(content, '')) - length({strip("coalesce(content, '')")}) AS sp, length({strip("coalesce(content, '')")}) - length(regexp_replace({strip("coalesce(content, '')")}, '{CJK}', '', 'g')) AS cj, length(coalesce(content, '')) - length(replace(coalesce(content, ''), chr(65533), '')) AS rp
        FROM infos i LEFT JOIN merged m ON i.document_id = m.document_id AND i.page = m.page)""",
    """st0 AS (SELECT document_id, page, count(type) AS items, coalesce(sum(ch), 0) AS ch, coalesce(sum(cj), 0) AS cj, coalesce(sum(sp), 0) AS sp, coalesce(sum(rp), 0) AS rp, coalesce(sum(CAST(off AS INTEGER)), 0) AS off, coalesce(sum(CAST(tiny AS INTEGER)), 0) AS tiny,
        avg(font_size) AS font, least(CAST(1 AS DOUBLE), coalesce(sum(area), CAST(0 AS DOUBLE)) / (612 * 792)) AS cover, list(l ORDER BY seq) FILTER (type IS NOT NULL) AS xs FROM meas GROUP BY 1, 2)""",
    """st AS (SELECT *, coalesce(sp / nullif(ch + sp, 0), 0) AS wr, coalesce(cj / nullif(ch, 0), 0) AS cr, coalesce(rp / nullif(ch, 0), 0) AS rr, ch >= 10 AS ext FROM st0)""",
    f"cols AS (SELECT document_id, page, count(*) AS reps FROM (SELECT document_id, page, {half_up('x / 5')} AS b, count(*) AS n FROM (SELECT document_id, page, unnest(xs) AS x FROM st0) GROUP BY ALL) WHERE n >= 4 GROUP BY 1, 2)",
    """fl AS (SELECT st.*, ch < 20 OR NOT ext AS scanned, wr > 0.7 AND ch > 5 AS garbled, rr >= 0.3 AND ch >= 10 AS cid, off > 0 OR (tiny > 2 AND tiny > items * 0.1) AS hidden, coalesce(reps, 0) AS reps FROM st LEFT JOIN cols USING (document_id, page))""",
    """det AS (SELECT *, CASE WHEN hidden OR garbled OR cid THEN 'suspicious' WHEN scanned THEN 'scanned_image' WHEN tbl THEN 'complex_layout' ELSE 'native_text' END AS cls FROM (SELECT *, NOT scanned AND items >= 15 AND cr <= 0.3 AND ch <= 10 * items AND reps >= 6 AS tbl FROM fl))""",
    "rec AS (SELECT *, CASE cls WHEN 'suspicious' THEN 'opendataloader_safety' WHEN 'scanned_image' THEN 'opendataloader_hybrid' ELSE 'opendataloader_default' END AS rec FROM det)",
    "runs AS (SELECT *, sum(new) OVER (PARTITION BY document_id ORDER BY page) AS g FROM (SELECT *, CASE WHEN rec <> lag(rec) OVER (PARTITION BY document_id ORDER BY page) THEN 1 ELSE 0 END AS new FROM rec))",
    f"""cand AS (SELECT m.document_id, m.page, m.seq, m.type, {trim('m.content')} AS text, struct_pack(x := {unit('m."left" / pw')}, y := {unit('(ph - m.bottom - (m.top - m.bottom)) / ph')}, w := {unit('(m."right" - m."left") / pw')}, h := {unit('(m.top - m.bottom) / ph')}) AS bb FROM merged m JOIN infos i ON m.document_id = i.document_id AND m.page = i.page WHERE {filled('m.content')} AND NOT {skipped('m.type')})""",
    f"candf AS (SELECT document_id, page, {fold('m', overlap('c[1].x', 'o.x') + ' >= 0.5')} AS kept FROM (SELECT document_id, page, list(struct_pack(seq := seq, x := lower({strip('text')})) ORDER BY seq) AS m FROM cand GROUP BY 1, 2))",
    f"""nat AS (SELECT c.document_id, c.page, c.seq, CASE lower(type) WHEN 'heading' THEN 'heading' WHEN 'paragraph' THEN 'paragraph' WHEN 'table' THEN 'table' WHEN 'list' THEN 'list' WHEN 'image' THEN 'image_ocr' WHEN 'picture' THEN 'image_ocr' ELSE 'unknown' END AS block_type, text, bb, {sha16('c.page', 'text')} AS h FROM cand c JOIN (SELECT document_id, unnest(kept).seq AS seq FROM candf) k USING (document_id, seq))""",
    """hole AS (SELECT document_id, page, max(CASE WHEN NOT """ + skipped("type") + " AND NOT " + filled("content") + """ AND (lower(type) <> 'table' OR rows_json IS NULL OR rows_json = '[]') THEN 1 ELSE 0 END) AS hole, max(CASE WHEN lower(type) = 'table' AND rows_json IS NOT NULL AND rows_json <> '[]' THEN 1 ELSE 0 END) AS tab FROM merged GROUP BY 1, 2)""",
    "trig AS (SELECT document_id, page, array_to_string(list_filter([CASE WHEN scanned THEN 'scan_or_low_text' END, CASE WHEN hole = 1 THEN 'structural_hole' END, CASE WHEN tab = 1 THEN 'table_layout' END], lambda x: x IS NOT NULL), ',') AS triggers FROM fl LEFT JOIN hole USING (document_id, page) WHERE scanned OR coalesce(hole, 0) = 1 OR coalesce(tab, 0) = 1)",
    f"ded AS (SELECT document_id, page, {fold('m', '(o.h = c[1].h AND o.s = c[1].s) OR (' + iou('o.b', 'c[1].b').replace('ELSE CAST(0 AS DOUBLE) END', 'ELSE CAST(0 AS DOUBLE) END') + ') >= 0.85').replace('o.s = c[1].s', 'true')} AS kept FROM (SELECT document_id, page, list(struct_pack(seq := seq, h := h, b := bb) ORDER BY seq) AS m FROM dup GROUP BY 1, 2))",
    # recognised lines, of all documents by their line ends
    "oln AS (SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS seq FROM documents WHERE text IS NOT NULL)",
    """ol AS (SELECT document_id, page, slot AS line_no, att AS attempt_no, CASE WHEN document_id % 12 = 0 AND slot = 0 THEN '人工智慧 草案' WHEN document_id % 6 = 0 AND slot IN (0, 2) THEN '條 文' WHEN document_id % 6 = 0 AND slot = 1 THEN '說明' WHEN document_id % 9 = 0 AND slot = 4 THEN '一、' || line
        WHEN document_id % 9 = 0 AND slot = 7 THEN '二:' || line WHEN document_id % 15 = 0 AND slot = 6 THEN '第三條 ' || line WHEN slot = 9 THEN '（二） 法律·規定 ' || line ELSE line END AS text,
        CAST(0.4 AS DOUBLE) + CAST((document_id * 7 + seq * 3) % 60 AS DOUBLE) / CAST(100 AS DOUBLE) + CAST(0.05 AS DOUBLE) * (att - 1) AS mean, x1, y1, x1 + least(CAST(5 AS DOUBLE) * length(line), CAST(540 AS DOUBLE)) AS x2, y1 + 40 AS y2
        FROM (SELECT *, CAST(CASE WHEN document_id % 12 = 0 AND slot = 0 THEN 500 WHEN document_id % 3 = 0 AND slot % 2 = 1 THEN 680 ELSE 60 END AS DOUBLE) AS x1, CAST(100 AS DOUBLE) + 60 * CASE WHEN document_id % 3 = 0 THEN slot // 2 ELSE slot END AS y1
              FROM (SELECT document_id, seq, line, seq % 14 AS slot, CAST(seq // 14 + 1 AS INTEGER) AS page FROM oln)), (VALUES (1), (2), (3), (4)) a(att))""",
    "att AS (SELECT document_id, page, attempt_no, avg(mean) AS m, count(*) AS n, document_id % 61 = 0 AS bad FROM ol GROUP BY ALL)",
    "cho AS (SELECT document_id, page, coalesce(min(CASE WHEN m >= 0.55 AND n > 0 THEN attempt_no END), max(attempt_no)) AS attempt_no, bool_or(bad) AS bad FROM att GROUP BY 1, 2)",
    "cl AS (SELECT ol.*, (x1 + x2) / 2 AS cx FROM ol JOIN (SELECT * FROM cho WHERE NOT bad) c USING (document_id, page, attempt_no))",
    f"""gsp AS (SELECT *, max(CASE WHEN ok THEN x2 END) OVER (PARTITION BY document_id, page ORDER BY x1, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM
        (SELECT *, length({trim('text')}) >= 2 AND y1 > 70 AND x2 - x1 <= 1275 * CAST(0.6 AS DOUBLE) AND NOT (y1 < 145 AND cx > 1275 * CAST(0.3 AS DOUBLE) AND cx < 1275 * CAST(0.7 AS DOUBLE) AND regexp_matches({strip('text')}, '草案|法案|文件')) AS ok FROM cl))""",
    """gut AS (SELECT document_id, page, arg_max((before + x1) / 2, [x1 - before, -abs((before + x1) / 2 - 637.5), -(before + x1) / 2]) AS g FROM gsp
        WHERE ok AND x1 > before AND (before + x1) / 2 >= 1275 * CAST(0.2 AS DOUBLE) AND (before + x1) / 2 <= 1275 * CAST(0.8 AS DOUBLE) GROUP BY 1, 2)""",
    f"""str AS (SELECT document_id, page, CASE WHEN bool_or(y1 < 240 AND contains({strip('text')}, '條文')) AND bool_or(y1 < 240 AND contains({strip('text')}, '說明')) THEN 'two_column_legal_table'
        WHEN count(*) FILTER (body) >= 12 AND count(*) FILTER (body AND cx < 1275 * 0.48) >= 5 AND count(*) FILTER (body AND cx > 1275 * 0.52) >= 5 AND (min(x1) FILTER (body AND cx > 1275 * 0.52) - max(x2) FILTER (body AND cx < 1275 * 0.48) > 1275 * 0.01 OR count(*) FILTER (body AND (cx < 1275 * 0.48 OR cx > 1275 * 0.52)) >= count(*) FILTER (body) * 0.75) THEN 'two_column_table' END AS strategy
        FROM (SELECT *, length({trim('text')}) >= 2 AND y1 > 70 AS body FROM cl) GROUP BY 1, 2)""",
    f"""lay AS (SELECT *, CASE WHEN strategy IS NULL THEN 9 WHEN role = 'title' THEN 0 WHEN role IN ('article', 'left') THEN 1 ELSE 2 END AS side, regexp_full_match({strip('text')}, '條文|說明|規定|備註|項目|類別|標準|內容|定義|理由|日期') AS hdr FROM
        (SELECT cl.*, strategy, CASE WHEN strategy IS NULL THEN 'unknown' WHEN y1 < 145 AND cx > 1275 * 0.3 AND cx < 1275 * 0.7 AND regexp_matches({strip('text')}, '草案|法案|文件') THEN 'title' WHEN strategy = 'two_column_legal_table' THEN CASE WHEN cx < 1275 * 0.5 THEN 'article' ELSE 'explanation' END ELSE CASE WHEN cx < 1275 * 0.5 THEN 'left' ELSE 'right' END END AS role
        FROM cl JOIN str USING (document_id, page) WHERE {filled('text')}))""",
    f"""isl AS (SELECT *, sum(new) OVER (PARTITION BY document_id, page, side ORDER BY place) AS island FROM (SELECT *, CASE WHEN side NOT IN (1, 2) OR hdr OR (CASE WHEN strategy = 'two_column_legal_table' THEN CASE WHEN side = 1 THEN regexp_matches({strip('text')}, '^第[{NUM}]+條') ELSE regexp_matches({trim('text')}, '^[{NUM}]+[、,，:：]') END ELSE regexp_matches({trim('text')}, '^[{NUM}]+[、,，:：]|^（[{NUM}]+）|^\\([{NUM}]+\\)') END)
        OR coalesce(lag(hdr) OVER (PARTITION BY document_id, page, side ORDER BY place), true) THEN 1 ELSE 0 END AS new FROM (SELECT *, row_number() OVER (PARTITION BY document_id, page, side ORDER BY CASE WHEN strategy IS NULL THEN line_no ELSE y1 END, CASE WHEN strategy IS NULL THEN line_no ELSE x1 END, line_no) AS place FROM lay)))""",
    f"""para AS (SELECT document_id, page, CAST(row_number() OVER (PARTITION BY document_id, page ORDER BY side, island) - 1 AS INTEGER) AS seq, CASE WHEN side NOT IN (1, 2) OR hdr THEN one ELSE joined END AS text, mean, x1, y1, x2, y2, coalesce(strategy, 'esearch_paragraphs') AS strategy, role FROM
        (SELECT document_id, page, strategy, side, island, arg_min(text, place) AS one, bool_or(hdr) AS hdr, string_agg({trim('text')}, '' ORDER BY place) AS joined, sum(mean * greatest(1, length(text))) / sum(greatest(1, length(text))) AS mean, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, arg_min(role, place) AS role FROM isl GROUP BY ALL))""",
    "raw AS (SELECT document_id, page, seq, text AS t, CAST([] AS VARCHAR[]) AS k FROM para)",
    *rewrite(BEFORE_TRIM, "raw", "rw"),
    f"rwt AS (SELECT * REPLACE ({trim('t')} AS t) FROM rw{len(BEFORE_TRIM) - 1})",
    *rewrite(AFTER_TRIM, "rwt", "rp"),
    f"cln AS (SELECT * FROM rp{len(AFTER_TRIM) - 1})",
    f"cvt AS (SELECT document_id, page, seq, text, {phrases(PHRASES, 1, 's0')} AS conv FROM (SELECT *, {phrases(PHRASES, 0, 'text')} AS s0 FROM para))",
    "cvr AS (SELECT document_id, page, seq, CASE WHEN conv <> text THEN conv ELSE '' END AS converted, conv AS t, CAST([] AS VARCHAR[]) AS k FROM cvt)",
    *rewrite(BEFORE_TRIM, "cvr", "cva"),
    f"cvm AS (SELECT * REPLACE ({trim('t')} AS t) FROM cva{len(BEFORE_TRIM) - 1})",
    *rewrite(AFTER_TRIM, "cvm", "cvb"),
    f"cvd AS (SELECT * FROM cvb{len(AFTER_TRIM) - 1})",
    f"""ob AS (SELECT p.document_id, p.page, CAST(row_number() OVER (PARTITION BY p.document_id, p.page ORDER BY CASE WHEN strategy = 'esearch_paragraphs' THEN 10 WHEN role = 'title' THEN 0 WHEN role IN ('article', 'left') THEN 1 ELSE 2 END, bb.y, bb.x, p.seq) - 1 AS INTEGER) AS seq, {trim('t')} AS text, t AS full_text, bb, least(CAST(0.99 AS DOUBLE), greatest(CAST(0.5 AS DOUBLE), mean)) AS conf, triggers, strategy, role FROM
        (SELECT para.*, t, struct_pack(x := {unit('x1 / 1275 * pw / pw')}, y := {unit('(ph - (ph - y2 / 1650 * ph) - (y2 / 1650 * ph - y1 / 1650 * ph)) / ph')}, w := {unit('(x2 / 1275 * pw - x1 / 1275 * pw) / pw')}, h := {unit('(y2 / 1650 * ph - y1 / 1650 * ph) / ph')}) AS bb FROM para JOIN cln USING (document_id, page, seq) JOIN infos USING (document_id, page)) p
        JOIN trig USING (document_id, page) WHERE {filled('t')})""",
    f"""mb AS (SELECT document_id, page, CAST(row_number() OVER (PARTITION BY document_id, page ORDER BY src, seq) - 1 AS INTEGER) AS seq, src, text, bb, h, conf FROM (SELECT document_id, page, seq, 0 AS src, text, bb, h, CAST(0.93 AS DOUBLE) AS conf FROM nat UNION ALL SELECT document_id, page, seq, 1, text, bb, {sha16('page', 'full_text')}, conf FROM ob))""",
    f"mbf AS (SELECT document_id, page, {fold('m', 'c[1].src = 1 AND ' + overlap('c[1].x', 'o.x') + ' >= 0.5')} AS kept FROM (SELECT document_id, page, list(struct_pack(seq := seq, src := src, x := lower({strip('text')})) ORDER BY seq) AS m FROM mb GROUP BY 1, 2))",
    "om AS (SELECT mb.* FROM mb JOIN (SELECT document_id, page, unnest(kept).seq AS seq FROM mbf) k USING (document_id, page, seq))",
]
PARTS += [
    f"omd AS (SELECT document_id, page, {fold('m', 'o.h = c[1].h OR (' + iou('o.b', 'c[1].b') + ') >= 0.85')} AS kept FROM (SELECT document_id, page, list(struct_pack(seq := seq, h := h, b := bb) ORDER BY seq) AS m FROM om GROUP BY 1, 2))",
    f"nmd AS (SELECT document_id, page, {fold('m', 'o.h = c[1].h OR (' + iou('o.b', 'c[1].b') + ') >= 0.85')} AS kept FROM (SELECT document_id, page, list(struct_pack(seq := seq, h := h, b := bb) ORDER BY seq) AS m FROM nat GROUP BY 1, 2))",
    "nfin AS (SELECT nat.* FROM nat JOIN (SELECT document_id, page, unnest(kept).seq AS seq FROM nmd) k USING (document_id, page, seq))",
    "fin AS (SELECT om.* FROM om JOIN (SELECT document_id, page, unnest(kept).seq AS seq FROM omd) k USING (document_id, page, seq))",
    f"newk AS (SELECT m.document_id, count(*) AS n FROM (SELECT document_id, {key()} AS key FROM merged WHERE {filled('content')}) m WHERE EXISTS (SELECT 1 FROM kd WHERE pass = 2 AND kd.document_id = m.document_id AND kd.key = m.key) AND NOT EXISTS (SELECT 1 FROM kd WHERE pass = 1 AND has AND kd.document_id = m.document_id AND kd.key = m.key) GROUP BY 1)",
    """nnote AS (SELECT document_id, 'ODL dual-pass: ' || n || ' empty block(s) filled via useStructTree pass' AS warning, 0 AS o, 0 AS p FROM newk
        UNION ALL SELECT DISTINCT document_id, '已啟用 OCR repair，但找不到 quality profile 的模型或缺少檔案（det/rec/dict）。略過 eSearch-OCR。', 1, 0 FROM trig
        UNION ALL SELECT d.document_id, '第 ' || d.page || ' 頁偵測到可解析文字但 blocks 為空，可能需要 fallback 解析。', 2, d.page FROM det d LEFT JOIN (SELECT DISTINCT document_id, page FROM nfin) f ON d.document_id = f.document_id AND d.page = f.page WHERE ext AND f.page IS NULL)""",
    """noted AS (SELECT document_id, 'ODL dual-pass: ' || n || ' empty block(s) filled via useStructTree pass' AS warning, 0 AS o, 0 AS p FROM newk
        UNION ALL SELECT DISTINCT t.document_id, 'OCR repair 第 ' || t.page || ' 頁失敗: render failed', 1, 0 FROM trig t JOIN cho c ON t.document_id = c.document_id AND t.page = c.page WHERE bad
        UNION ALL SELECT d.document_id, '第 ' || d.page || ' 頁偵測到可解析文字但 blocks 為空，可能需要 fallback 解析。', 2, d.page FROM det d LEFT JOIN (SELECT DISTINCT document_id, page FROM fin) f ON d.document_id = f.document_id AND d.page = f.page WHERE ext AND f.page IS NULL)""",
]
_DUP = f"""dup AS (SELECT document_id, page, CAST(row_number() OVER (PARTITION BY document_id, page ORDER BY pass, seq) - 1 AS INTEGER) AS seq, struct_pack(x := {unit('"left" / 612')}, y := {unit('(CAST(792 AS DOUBLE) - bottom - (top - bottom)) / 792')}, w := {unit('("right" - "left") / 612')}, h := {unit('(top - bottom) / 792')}) AS bb, {sha16('page', trim('content'))} AS h FROM items WHERE {filled('content')} AND NOT {skipped('type')})"""
PARTS.insert(next(i for i, p in enumerate(PARTS) if p.startswith("ded AS")), _DUP)


def with_parts(select: str) -> str:
    """The query with the parts that it needs."""
    import re

    names = [p.split(" ", 1)[0] for p in PARTS]
    need, todo = set(), [select]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name, part in zip(names, PARTS, strict=True):
            if name in words and name not in need:
                need.add(name)
                todo.append(part.split(" AS ", 1)[1])
    used = [p for n, p in zip(names, PARTS, strict=True) if n in need]
    return ("WITH " + ",\n".join(used) + "\n" if used else "") + select


R = "round({}, 6)".format
_SELECTS = {
    "block_key": f"SELECT document_id, pass, seq, {key()} AS key FROM items",
    "source_hash": f"SELECT document_id, pass, seq, {sha16('page', trim('content'))} AS source_hash FROM items WHERE {filled('content')}",
    "type_map": "SELECT type, CASE WHEN type IN ('heading', 'paragraph', 'table', 'list') THEN type ELSE 'unknown' END AS block_type, count(*) AS n FROM items GROUP BY ALL",
    "bbox_normalize": f"""SELECT document_id, pass, seq, {R(unit('"left" / 612'))} AS x, {R(unit('(CAST(792 AS DOUBLE) - bottom - (top - bottom)) / 792'))} AS y, {R(unit('("right" - "left") / 612'))} AS width, {R(unit('(top - bottom) / 792'))} AS height FROM items""",
    "bbox_if_needed": f"""SELECT document_id, pass, seq, {R(unit('"left" / 612'))} AS x, {R(unit('(CAST(792 AS DOUBLE) - bottom - (top - bottom)) / 792'))} AS y, {R(unit('("right" - "left") / 612'))} AS width, {R(unit('(top - bottom) / 792'))} AS height, 'normalized' AS coordinate_system FROM items""",
    "selection": f"SELECT document_id, sha256('opendataloader-default:' || document_id || ':' || page || ':' || seq)[1:32] AS id, CAST(page AS INTEGER) AS page, {R('bb.x')} AS x, {R('bb.y')} AS y, {R('bb.w')} AS width, {R('bb.h')} AS height FROM nat",
    "quad_bbox": f"SELECT document_id, page, line_no, {R(unit('x1 / 1275'))} AS x, {R(unit('y1 / 1650'))} AS y, {R(unit('(x2 - x1) / 1275'))} AS width, {R(unit('(y2 - y1) / 1650'))} AS height FROM ol WHERE attempt_no = 1",
    "collapse_ws": f"SELECT document_id, pass, seq, lower({strip('content')}) AS collapsed FROM items WHERE content IS NOT NULL",
    "char_census": f"SELECT document_id, pass, seq, length({strip('c')}) AS chars, length(c) - length({strip('c')}) AS spaces, length({strip('c')}) - length(regexp_replace({strip('c')}, '{CJK}', '', 'g')) AS cjk, length(c) - length(replace(c, chr(65533), '')) AS replaced FROM (SELECT *, coalesce(content, '') AS c FROM items)",
    "overlap_ratio": f"SELECT a.document_id, a.seq, {R(overlap('a.x', 'b.x'))} AS ratio FROM (SELECT document_id, seq, lower({strip('txt')}) AS x FROM box) a JOIN (SELECT document_id, seq + 1 AS seq, lower({strip('txt')}) AS x FROM box) b USING (document_id, seq)",
    "iou_pairs": f"SELECT a.document_id, a.seq, {R(iou('a.bb', 'b.bb'))} AS iou FROM dup a JOIN dup b ON a.document_id = b.document_id AND a.page = b.page AND b.seq = a.seq + 1",
    "pass_fill": f"""SELECT document_id, seq, filled, s.type AS type, {R('s.l')} AS "left", s.content AS content FROM fill""",
    "pass_extras": f"""SELECT document_id, seq, s.page AS page, {R('s.l')} AS "left", s.content AS content FROM extra""",
    "dual_pass_merge": f"""SELECT document_id, seq, page, type, {R('"left"')} AS "left", top, content FROM merged""",
    "filled_count": f"""SELECT m.document_id, count(*) AS n_filled FROM (SELECT document_id, {key()} AS key FROM merged WHERE {filled('content')}) m WHERE EXISTS (SELECT 1 FROM kd WHERE pass = 2 AND kd.document_id = m.document_id AND kd.key = m.key) AND NOT EXISTS (SELECT 1 FROM kd WHERE pass = 1 AND has AND kd.document_id = m.document_id AND kd.key = m.key) GROUP BY 1""",
    "page_stats": f"SELECT document_id, CAST(page AS INTEGER) AS page, items AS text_item_count, CAST(ch AS BIGINT) AS char_count, CAST(cj AS BIGINT) AS cjk_char_count, CAST(sp AS BIGINT) AS whitespace_count, CAST(rp AS BIGINT) AS replacement_char_count, CAST(off AS BIGINT) AS off_page_item_count, CAST(tiny AS BIGINT) AS tiny_text_item_count, {R('font')} AS avg_font_size, {R('cover')} AS bbox_coverage_ratio, {R('wr')} AS whitespace_ratio, {R('cr')} AS cjk_char_ratio, {R('rr')} AS replacement_char_ratio, ext AS has_extractable_text FROM st",
    "repeated_columns": "SELECT st.document_id, CAST(st.page AS INTEGER) AS page, CAST(coalesce(reps, 0) AS INTEGER) AS repeated FROM st LEFT JOIN cols USING (document_id, page)",
    "classify_pages": "SELECT document_id, CAST(page AS INTEGER) AS page, scanned, garbled, cid, tbl AS table_heavy, hidden, cls AS layout_class, rec AS parser_recommendation, CASE cls WHEN 'suspicious' THEN 'detected hidden/off-page text or garbled text' WHEN 'scanned_image' THEN 'low extractable text count' WHEN 'complex_layout' THEN 'table-heavy layout detected' ELSE 'ODL-only parser path' END || CASE WHEN cid THEN '|CID font encoding issue: ' || printf('%.0f', rr * 100) || '% replacement chars' ELSE '' END AS reasons FROM rec",
    "layout_summary": "SELECT cls AS layout_class, count(DISTINCT document_id) AS n_documents, count(*) AS n_pages FROM det GROUP BY 1",
    "layout_sentence": "SELECT document_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN len({c}) > 0 THEN '第 ' || CASE WHEN len({c}) <= 5 THEN array_to_string({c}, '、') ELSE {c}[1] || '-' || {c}[-1] END || ' {w}' END" for c, w in (("a", "頁為原生文字"), ("b", "頁疑似掃描影像"), ("c", "頁為複雜排版"), ("d", "頁含可疑內容"))) + "], lambda x: x IS NOT NULL), '，') || '。' AS summary FROM (SELECT document_id, " + ", ".join(f"list(page ORDER BY page) FILTER (cls = '{k}') AS {c}" for c, k in (("a", "native_text"), ("b", "scanned_image"), ("c", "complex_layout"), ("d", "suspicious"))) + " FROM det GROUP BY 1)",
    "page_labels": "SELECT document_id, CAST(page AS INTEGER) AS page, CASE cls WHEN 'native_text' THEN '原生文字' WHEN 'scanned_image' THEN '掃描影像' WHEN 'complex_layout' THEN '複雜排版' ELSE '可疑內容' END AS label, CASE cls WHEN 'native_text' THEN 'success' WHEN 'suspicious' THEN 'danger' ELSE 'warning' END AS tag FROM det",
    "routing_plan": "SELECT document_id, CAST(g AS INTEGER) AS group_no, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS pages, CASE WHEN any_value(rec) <> 'opendataloader_default' THEN 'opendataloader_hybrid' ELSE any_value(rec) END AS parser, CASE WHEN any_value(rec) <> 'opendataloader_default' THEN 'hint_plus_detection' ELSE 'system_detection' END AS reason FROM runs GROUP BY document_id, g",
    "routing_warnings": "SELECT document_id, CAST(g + 2 AS INTEGER) AS ord, '第 ' || string_agg(CAST(page AS VARCHAR), ', ' ORDER BY page) || ' 頁偵測到 hidden/off-page 或亂碼文字風險，已路由至安全過濾路徑。' AS warning FROM runs WHERE hidden OR garbled GROUP BY document_id, g UNION ALL SELECT DISTINCT document_id, 0, '目前後端已固定使用 OpenDataLoader；原生文字解析偏好只保留為輸入紀錄，不會切換 parser。' FROM det UNION ALL SELECT DISTINCT document_id, 1, '目前 OCR 僅作 OpenDataLoader 後的 page-level repair；不會取代 ODL 主解析。' FROM det",
    "native_blocks": f"SELECT document_id, CAST(page AS INTEGER) AS page, seq, block_type, text, {R('bb.x')} AS x, {R('bb.y')} AS y, {R('bb.w')} AS width, {R('bb.h')} AS height, h AS source_hash FROM nat",
    "block_types": "SELECT block_type, CASE block_type WHEN 'heading' THEN '標題' WHEN 'paragraph' THEN '段落' WHEN 'table' THEN '表格' WHEN 'list' THEN '清單' ELSE '未知' END AS label, count(*) AS n FROM nat GROUP BY ALL",
    "dedupe_blocks": "SELECT document_id, CAST(page AS INTEGER) AS page, unnest(kept).seq AS seq FROM ded",
    "structural_holes": "SELECT document_id, CAST(page AS INTEGER) AS page FROM hole WHERE hole = 1",
    "repair_triggers": "SELECT document_id, CAST(page AS INTEGER) AS page, triggers FROM trig",
    "repair_page_cap": "SELECT document_id, CAST(page AS INTEGER) AS page FROM trig QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY page) <= 2",
    "cap_warnings": "SELECT document_id, 'OCR repair 使用 dev profile，僅處理前 2 / ' || count(*) || ' 個觸發頁面。' AS warning FROM trig GROUP BY 1 HAVING count(*) > 2",
    "ingest_without_models": """SELECT i.document_id, coalesce(n, 0) AS n_blocks, coalesce(w, '') AS warnings FROM (SELECT DISTINCT document_id FROM infos) i LEFT JOIN (SELECT document_id, count(*) AS n FROM nfin GROUP BY 1) b ON i.document_id = b.document_id
        LEFT JOIN (SELECT document_id, string_agg(warning, '|' ORDER BY o, p) AS w FROM nnote GROUP BY 1) x ON i.document_id = x.document_id
        UNION ALL SELECT DISTINCT -1 - document_id, 0, 'ODL 兩個 pass 均無輸出，可能 PDF 無可提取文字。|已啟用 OCR repair，但找不到 quality profile 的模型或缺少檔案（det/rec/dict）。略過 eSearch-OCR。' FROM infos""",
    "ocr_cascade": f"SELECT c.document_id, c.page, CASE WHEN c.bad THEN 1 ELSE c.attempt_no END AS n_attempts, CASE WHEN c.bad THEN 1 ELSE c.attempt_no END AS attempt_no, CASE WHEN c.bad THEN CAST(0 AS DOUBLE) ELSE {R('m')} END AS mean_confidence, CASE WHEN c.bad THEN 0 ELSE n END AS paragraph_count, CASE WHEN c.bad THEN 'render failed' ELSE '' END AS error FROM cho c JOIN att USING (document_id, page, attempt_no)",
    "ocr_attempt_choice": f"SELECT c.document_id, c.page, c.attempt_no, {R('m')} AS mean_confidence, n AS paragraph_count FROM cho c JOIN att USING (document_id, page, attempt_no)",
    "ocr_attempt_log": "SELECT document_id, page, CASE attempt_no WHEN 1 THEN 'poppler_raster_150,primary_ocr_150' WHEN 2 THEN 'poppler_raster_150,primary_ocr_150,preprocess_greyscale_normalize,primary_ocr_150' WHEN 3 THEN 'poppler_raster_150,primary_ocr_150,preprocess_greyscale_normalize,primary_ocr_150,reraster_220,primary_ocr_220' ELSE 'poppler_raster_150,primary_ocr_150,preprocess_greyscale_normalize,primary_ocr_150,reraster_220,primary_ocr_220,fallback_rec_ppocr_v4_doc,fallback_rec_ppocr_v4_doc_220' END AS log FROM cho",
    "ocr_blocks": f"SELECT document_id, page, seq, text, {R('bb.x')} AS x, {R('bb.y')} AS y, {R('bb.w')} AS width, {R('bb.h')} AS height, {R('conf')} AS confidence, {sha16('page', 'full_text')} AS source_hash, triggers, strategy, role FROM ob",
    "ocr_failures": "SELECT DISTINCT t.document_id, 'OCR repair 第 ' || t.page || ' 頁失敗: render failed' AS warning FROM trig t JOIN cho c ON t.document_id = c.document_id AND t.page = c.page WHERE bad",
    "ocr_merge": "SELECT document_id, CAST(page AS INTEGER) AS page, seq, CASE WHEN src = 0 THEN 'opendataloader-default' ELSE 'esearch-ocr-repair' END AS parser, text FROM om",
    "layout_strategy": "SELECT document_id, page, strategy FROM str",
    "column_split": f"SELECT document_id, page, {R('any_value(coalesce(g, 637.5))')} AS gutter, count(*) FILTER (cx < coalesce(g, 637.5)) AS n_left, count(*) FILTER (cx >= coalesce(g, 637.5)) AS n_right FROM cl LEFT JOIN gut USING (document_id, page) GROUP BY 1, 2",
    "layout_headers": f"SELECT document_id, page, bool_or(y1 < 240 AND cx < 420 AND regexp_matches({strip('text')}, '條文|規定|項目|類別|標準|內容')) AND bool_or(y1 < 240 AND cx >= 250 AND regexp_matches({strip('text')}, '說明|備註|定義|理由|日期|規定')) AS has_headers FROM cl GROUP BY 1, 2",
    "paragraph_merge": f"SELECT document_id, page, seq, text, {R('mean')} AS mean, x1, y1, x2, y2, role FROM para",
    "layout_order": "SELECT document_id, page, string_agg(role, ',' ORDER BY seq) AS roles FROM para GROUP BY 1, 2",
    "text_cleanup": "SELECT document_id, page, seq, t AS text FROM cln",
    "script_conversion": "SELECT document_id, page, seq, converted, t AS text, CAST(len(list_filter(k, lambda x: starts_with(x, 'ocr_confusion:'))) AS INTEGER) AS n_confusions FROM cvd",
    "cleanup_trail": "SELECT document_id, page, seq, CAST(len(k) AS INTEGER) AS n_fixes, array_to_string(k, '|') AS trail FROM cln",
    "ingest_documents": "SELECT d.document_id, coalesce(n, 0) AS n_blocks, coalesce(r, 0) AS n_repaired, coalesce(texts, '') AS texts, coalesce(warnings, '') AS warnings FROM (SELECT DISTINCT document_id FROM infos) d LEFT JOIN (SELECT document_id, count(*) AS n, count(*) FILTER (src = 1) AS r, string_agg(text, '|' ORDER BY page, seq) AS texts FROM fin GROUP BY 1) b USING (document_id) LEFT JOIN (SELECT document_id, string_agg(warning, '|' ORDER BY o, p, warning) AS warnings FROM noted GROUP BY 1) w USING (document_id)",
    "page_quality": f"SELECT d.document_id, CAST(d.page AS INTEGER) AS page, coalesce(n, 0) AS n_blocks, {R('c')} AS avg_confidence, coalesce(n, 0) = 0 AND ext AS is_empty, coalesce(n, 0) > 0 AND coalesce(c, 1) < 0.5 AS is_low FROM det d LEFT JOIN (SELECT document_id, page, count(*) AS n, avg(CAST(0.93 AS DOUBLE)) AS c FROM nat GROUP BY 1, 2) USING (document_id, page)",
    "quality_report": "SELECT document_id, count(*) FILTER (e) > 0 AS requires_fallback, '' AS low_confidence_pages, coalesce(string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) FILTER (e), '') AS empty_pages, coalesce(string_agg('第 ' || page || ' 頁偵測到可解析文字但 blocks 為空，可能需要 fallback 解析。', '|' ORDER BY page) FILTER (e), '') AS warnings FROM (SELECT d.document_id, d.page, ext AND n.page IS NULL AS e FROM det d LEFT JOIN (SELECT DISTINCT document_id, page FROM nat) n ON d.document_id = n.document_id AND d.page = n.page) GROUP BY 1",
    "warnings_distinct": "SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY o, w) - 1 AS INTEGER) AS ord, w AS warning FROM (SELECT document_id, content AS w, min(pass * 1000000 + seq) AS o FROM items WHERE content IS NOT NULL GROUP BY 1, 2)",
    "export_page_text": "SELECT document_id, CAST(page AS INTEGER) AS page, string_agg(text, chr(10) ORDER BY bb.y, bb.x, seq) AS text FROM nat GROUP BY 1, 2",
    "export_document_text": "SELECT document_id, string_agg('# 第 ' || page || ' 頁' || chr(10) || x, chr(10) || chr(10) ORDER BY page) AS text FROM (SELECT document_id, page, string_agg(text, chr(10) ORDER BY bb.y, bb.x, seq) AS x FROM nat GROUP BY 1, 2) GROUP BY 1",
    "highlights": f"SELECT document_id, CAST(page AS INTEGER) AS page, seq, {R('bb.x * 800')} AS \"left\", {R('bb.y * 1000')} AS top, {R('greatest(CAST(0 AS DOUBLE), bb.y * 1000 + 24 - 80)')} AS scroll_top FROM nat WHERE bb.w > 0 AND bb.h > 0",
    "backend_label": "SELECT document_id, CASE WHEN bool_or(src = 0) AND bool_or(src = 1) THEN 'OpenDataLoader + eSearch-OCR' WHEN bool_or(src = 1) THEN 'eSearch-OCR' ELSE 'OpenDataLoader' END AS label FROM om GROUP BY 1",
    "file_labels": "SELECT doc_id AS document_id, CASE WHEN n < 1024 THEN n || ' B' ELSE printf('%.1f', floor(n * 10 / CAST(1024 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / 10) || ' KB' END AS size, 'file-' || doc_id || '.txt' AS file_name FROM (SELECT doc_id, octet_length(encode(text)) AS n FROM documents WHERE text IS NOT NULL)",
    "page_infos_text": "SELECT document_id, CAST(page AS INTEGER) AS page, CASE WHEN document_id % 2 = 0 THEN CAST(600 + page AS DOUBLE) ELSE CAST(595.5 AS DOUBLE) END AS page_width, CAST(842 AS DOUBLE) AS page_height FROM infos",
    "parser_json": "SELECT document_id, pass, seq, type, page, \"left\", top, content, rows_json FROM items WHERE pass = 1",
    "html_items": r"""SELECT page_id AS document_id, CAST(i - 1 AS INTEGER) AS seq, CASE regexp_extract(e, '^<(h1|p|li|footer)', 1) WHEN 'h1' THEN 'heading' WHEN 'p' THEN 'paragraph' WHEN 'li' THEN 'list' ELSE 'footer' END AS type, trim(regexp_replace(regexp_replace(e, '(?s)<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS content FROM (SELECT page_id, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?s)<(?:h1|p|li|footer)\b[^>]*>.*?</(?:h1|p|li|footer)>') AS x FROM pages))""",
    "preview_document": "SELECT d.document_id, coalesce(b.n, 0) AS n_blocks, coalesce(texts, '') AS texts, p AS n_pages, coalesce(blocks, '') AS blocks, detections, coalesce('ODL dual-pass: ' || w.n || ' empty block(s) filled via useStructTree pass', '') AS warnings FROM (SELECT document_id, count(*) AS p, string_agg(page || ':' || cls || ':' || rec, '|' ORDER BY page) AS detections FROM rec GROUP BY 1) d LEFT JOIN (SELECT document_id, count(*) AS n, string_agg(text, '|' ORDER BY page, seq) AS texts, string_agg(block_type || ':' || page || ':' || h || ':opendataloader-default:native_text', '|' ORDER BY page, seq) AS blocks FROM nat GROUP BY 1) b USING (document_id) LEFT JOIN newk w USING (document_id)",
}
SQL = {k: with_parts(v) for k, v in _SELECTS.items()}
