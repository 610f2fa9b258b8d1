"""DuckDB SQL for the operators that it can express: fingerprints and components, repeated bytes, the mix,
near vectors, repaired conversations, fill-in-middle outputs.

Where a hash decides, it is computed in SQL: XXH64 over the bytes of a text, in
128-bit whole numbers.
"""

from __future__ import annotations

from .mixing import MOST_REPEATS, WEIGHTS

M = 1 << 64
#: The factors of XXH64. Fixed values.
P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
WORDS = r"[^\x20\x09-\x0D]+"


def _n(x: int) -> str:
    return f"{x}::UHUGEINT"


def _rotl(x: str, r: int) -> str:
    return f"(({x}) * {_n(1 << r)} % {_n(M)} + ({x}) // {_n(1 << (64 - r))})"


def _xor(a: str, b: str) -> str:
    return f"xor(CAST({a} AS UBIGINT), CAST({b} AS UBIGINT))::UHUGEINT"


def _lane(at: str, size: int) -> str:
    """A little-endian number of ``size`` bytes at a place of the column ``x`` (hexadecimal digits)."""
    parts = " || ".join(f"substr(x, CAST(({at}) * 2 + {2 * k + 1} AS BIGINT), 2)" for k in reversed(range(size)))
    return f"CAST('0x' || {parts} AS UBIGINT)::UHUGEINT"


def _round(v: str, lane: str) -> str:
    return f"({_rotl(f'({v} + {lane} * {_n(P2)} % {_n(M)}) % {_n(M)}', 31)} * {_n(P1)} % {_n(M)})"


def xxh64(name: str, source: str, text: str, seed: str) -> str:
    """CTEs that end with ``name``: ``source`` with ``h``, the hash of the bytes of its column ``text``."""
    stripes = "list_reduce(range(0, len_ // 32), lambda s, i: {" + ", ".join(f"'{v}': {_round(f's.{v}', _lane(f'i * 32 + {8 * k}', 8))}" for k, v in enumerate("abcd")) + "}, {"
    stripes += f"'a': (seed_ + {_n((P1 + P2) % M)}) % {_n(M)}, 'b': (seed_ + {_n(P2)}) % {_n(M)}, 'c': seed_, 'd': (seed_ + {_n(M - P1)}) % {_n(M)}}})"
    out = [f"{name}0 AS (SELECT *, hex(encode({text})) AS x, CAST(strlen({text}) AS BIGINT) AS len_, strlen({text})::UHUGEINT AS size_, ({seed})::UHUGEINT AS seed_ FROM {source})", f"{name}1 AS (SELECT *, CASE WHEN len_ >= 32 THEN {stripes} END AS s FROM {name}0)"]
    start = " + ".join(_rotl(f"s.{v}", r) for v, r in zip("abcd", (1, 7, 12, 18)))
    out.append(f"{name}2 AS (SELECT *, CASE WHEN len_ >= 32 THEN ({start}) % {_n(M)} END AS m FROM {name}1)")
    at = 2
    for v in "abcd":
        out.append(f"{name}{at + 1} AS (SELECT * REPLACE (CASE WHEN len_ >= 32 THEN ({_xor('m', _round(_n(0), f's.{v}'))} * {_n(P1)} % {_n(M)} + {_n(P4)}) % {_n(M)} END AS m) FROM {name}{at})")
        at += 1
    eight = f"({_rotl(_xor('h', _round(_n(0), _lane('p', 8))), 27)} * {_n(P1)} % {_n(M)} + {_n(P4)}) % {_n(M)}"
    one = f"{_rotl(_xor('h', f'{_lane("p", 1)} * {_n(P5)} % {_n(M)}'), 11)} * {_n(P1)} % {_n(M)}"
    four = f"({_rotl(_xor('g', f'{_lane("len_ // 8 * 8", 4)} * {_n(P1)} % {_n(M)}'), 23)} * {_n(P2)} % {_n(M)} + {_n(P3)}) % {_n(M)}"
    out.append(f"{name}7 AS (SELECT *, list_reduce(range(len_ // 32 * 32, len_ // 8 * 8, 8), lambda h, p: {eight}, (CASE WHEN len_ >= 32 THEN m ELSE seed_ + {_n(P5)} END + size_) % {_n(M)}) AS g FROM {name}{at})")
    out.append(f"{name}8 AS (SELECT * REPLACE (CASE WHEN len_ % 8 >= 4 THEN {four} ELSE g END AS g) FROM {name}7)")
    out.append(f"{name}9 AS (SELECT * REPLACE (list_reduce(range(len_ - len_ % 4, len_), lambda h, p: {one}, g) AS g) FROM {name}8)")
    out.append(f"{name}10 AS (SELECT * REPLACE ({_xor('g', f'g // {_n(1 << 33)}')} * {_n(P2)} % {_n(M)} AS g) FROM {name}9)")
    out.append(f"{name}11 AS (SELECT * REPLACE ({_xor('g', f'g // {_n(1 << 29)}')} * {_n(P3)} % {_n(M)} AS g) FROM {name}10)")
    out.append(f"{name} AS (SELECT * EXCLUDE (x, len_, size_, seed_, s, m, g), xor(CAST(g AS UBIGINT), CAST(g // {_n(1 << 32)} AS UBIGINT)) AS h FROM {name}11)")
    return ", ".join(out)


_BITS = ", ".join(f"sum(((h >> {b}) & 1) * n) AS b{b}" for b in range(64))
_FP = " + ".join(f"CASE WHEN b{b} * 2 > n THEN {1 << b}::UBIGINT ELSE 0::UBIGINT END" for b in range(64))

SIMHASH = rf"""WITH RECURSIVE w AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS ws FROM documents),
g AS (SELECT doc_id, row, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS t FROM w),
k AS (SELECT DISTINCT t FROM g), {xxh64("z", "k", "t", "42")}, c AS (SELECT row, t, count(*) AS n FROM g GROUP BY ALL), s AS (SELECT row, sum(n) AS n, {_BITS} FROM c JOIN z USING (t) GROUP BY row),
f AS (SELECT w.doc_id, coalesce({_FP}, 0::UBIGINT) AS fp FROM w LEFT JOIN s USING (row)), d AS (SELECT fp, min(doc_id) AS low FROM f GROUP BY fp), e AS (SELECT a.fp AS a, b.fp AS b FROM d a JOIN d b ON bit_count(xor(a.fp, b.fp)) <= 2),
r AS (SELECT fp AS a, fp AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), m AS (SELECT r.a AS fp, min(low) AS component_id FROM r JOIN d ON r.b = d.fp GROUP BY r.a)
SELECT doc_id, lpad(lower(to_hex(fp)), 16, '0') AS fingerprint, component_id FROM f JOIN m USING (fp)"""

REPEATS = """WITH t AS (SELECT doc_id, row_number() OVER () AS row, hex(encode(coalesce(text, ''))) AS x, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents), w AS (SELECT row, unnest(range(0, n - 199)) AS i, x FROM t WHERE n >= 200),
h AS (SELECT row, i, md5(substr(x, CAST(i * 2 + 1 AS BIGINT), 400)) AS h FROM w), q AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY h) AS c FROM h) WHERE c > 1),
b AS (SELECT row, i, i - 200 > lag(i, 1, -1000) OVER (PARTITION BY row ORDER BY i) AS fresh FROM q), p AS (SELECT row, i, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY row ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM b),
s AS (SELECT row, run, min(i) AS a, max(i) + 200 AS z FROM p GROUP BY ALL), k AS (SELECT row, a, z, coalesce(lag(z) OVER (PARTITION BY row ORDER BY a), 0) AS before FROM s),
o AS (SELECT row, count(*) AS spans, sum(z - a) AS gone, max(z) AS last, string_agg(substr(x, CAST(before * 2 + 1 AS BIGINT), CAST((a - before) * 2 AS BIGINT)), '' ORDER BY a) AS kept FROM k JOIN t USING (row) GROUP BY row)
SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(CASE WHEN spans IS NULL THEN x ELSE kept || substr(x, CAST(last * 2 + 1 AS BIGINT)) END)) AS kept_sha256 FROM t LEFT JOIN o USING (row)"""

_WEIGHT = "[" + ", ".join(str(w) for w in WEIGHTS) + "]"

MIX = rf"""WITH RECURSIVE t AS (SELECT doc_id, row_number() OVER () AS row, source, coalesce(text, '') AS text, coalesce(CAST(doc_id AS VARCHAR), '') AS id, 'mix' AS salt, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS BIGINT) AS size FROM documents),
{xxh64("u", "t", "salt", "42")}, v AS (SELECT * RENAME (h AS seed1) FROM u), {xxh64("y", "v", "id", "seed1")}, yy AS (SELECT * RENAME (h AS seed2) FROM y), {xxh64("z", "yy", "text", "seed2")}, d AS (SELECT doc_id, row, source, size, h >> 4 AS h FROM z),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS size, {_WEIGHT}[CAST((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % {len(WEIGHTS)} AS BIGINT) + 1]::DOUBLE AS weight FROM d GROUP BY source), total AS (SELECT CAST(sum(size) AS DOUBLE) AS t FROM src),
lv AS (SELECT 0 AS i, 0.0::DOUBLE AS share UNION ALL SELECT i + 1, (SELECT (t - coalesce(sum({MOST_REPEATS}.0 * size) FILTER (lv.share * weight > {MOST_REPEATS}.0 * size), 0)) / nullif(sum(weight) FILTER (NOT (lv.share * weight > {MOST_REPEATS}.0 * size)), 0) FROM src, total GROUP BY t) FROM lv WHERE i < 60 AND share IS NOT NULL),
fin AS (SELECT max(share) AS share FROM lv), goal AS (SELECT source, size, CASE WHEN share * weight > {MOST_REPEATS}.0 * size THEN {MOST_REPEATS}.0 * size ELSE share * weight END AS target FROM src, fin), g AS (SELECT *, CASE WHEN size > 0 THEN least({MOST_REPEATS}, CAST(floor(target / size) AS BIGINT)) ELSE 0 END AS whole FROM goal), b AS (SELECT *, target - whole * size AS budget FROM g),
hs AS (SELECT source, h, sum(size) AS size FROM d GROUP BY ALL), c AS (SELECT source, h, size, sum(size) OVER (PARTITION BY source ORDER BY h ROWS UNBOUNDED PRECEDING) AS run FROM hs),
x AS (SELECT c.source, min_by({{'h': h, 'left': budget - (run - c.size), 'size': c.size}}, h) AS e FROM c JOIN b ON b.source IS NOT DISTINCT FROM c.source WHERE run > budget GROUP BY c.source),
cut AS (SELECT b.source, b.size, b.target, b.whole, CASE WHEN whole >= {MOST_REPEATS} OR budget <= 0 THEN 0::UBIGINT WHEN e IS NULL THEN {1 << 60}::UBIGINT ELSE e.h + CASE WHEN e.size - e.left <= e.left THEN 1::UBIGINT ELSE 0::UBIGINT END END AS cut FROM b LEFT JOIN x ON x.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, d.size, cut.size AS source_size, target, CAST(d.size * (whole + CASE WHEN d.h < cut THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM d JOIN cut ON cut.source IS NOT DISTINCT FROM d.source"""

VECTORS = """WITH RECURSIVE v AS (SELECT vec_id, row_number() OVER () AS row, label, CASE WHEN len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN CAST(embedding AS DOUBLE[]) END AS e FROM embeddings),
p AS (SELECT a.row AS a, b.row AS b FROM v a JOIN v b ON a.label = b.label AND a.row <> b.row AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT row AS a, row AS b FROM v UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a), c AS (SELECT r.a AS row, min(v.vec_id) AS component_id FROM r JOIN v ON r.b = v.row GROUP BY r.a), n AS (SELECT a AS row, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM v JOIN c USING (row) LEFT JOIN n USING (row)"""

def _crc32(text: str) -> str:
    """The CRC-32 of a text's bytes, bit by bit."""
    byte = f"CAST('0x' || substr(hex(encode({text})), CAST(i // 8 * 2 + 1 AS BIGINT), 2) AS BIGINT)"
    start = f"CASE WHEN i % 8 = 0 THEN xor(c, {byte}) ELSE c END"
    return f"xor(list_reduce(range(strlen({text}) * 8), lambda c, i: CASE WHEN ({start}) % 2 = 1 THEN xor(({start}) // 2, {0xEDB88320}) ELSE ({start}) // 2 END, {0xFFFFFFFF}::BIGINT), {0xFFFFFFFF}::BIGINT)"


def _insert(v: str) -> str:
    """The four states' best (cost, letters) with rows inserted; ``least`` of structs goes by cost, then by letters."""
    add = lambda s: f"{{'c': ({s}).c + 2, 'a': ({s}).a || 'I'}}"
    two = f"least({v}.s2, {add(f'{v}.s0')}, {add(f'{v}.s1')}, {add(f'{v}.s3')})"
    return f"{{'s0': {v}.s0, 's1': {v}.s1, 's2': {two}, 's3': least({v}.s3, {add(two)})}}"


def _edit() -> str:
    """The states behind a row ``r`` from those before it, ``w``: deleted, kept or reroled."""
    add = lambda s, n, letter: f"{{'c': w.{s}.c + {n}, 'a': w.{s}.a || '{letter}'}}"
    far = "{'c': 1000000000, 'a': ''}"
    keep = lambda s, i: f"CASE WHEN r.f < 2 AND r.i = '{i}' THEN {add(s, 'r.f', 'K')} ELSE {far} END"
    role = lambda s: f"CASE WHEN r.f < 2 THEN {add(s, '2 + r.f', 'R')} ELSE {far} END"
    gone = lambda s: add(s, 3, "D")
    to2 = ", ".join([gone("s2"), *[keep(s, "u") for s in ("s0", "s1", "s3")], *[role(s) for s in ("s0", "s1", "s3")]])
    return f"{{'s0': {gone('s0')}, 's1': least({gone('s1')}, {keep('s0', 's')}), 's2': least({to2}), 's3': least({gone('s3')}, {keep('s2', 'a')}, {role('s2')})}}"


_FAR = "{'c': 1000000000, 'a': ''}"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

DIALOGUES = f"""WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations), h AS (SELECT *, {_crc32("k")} % 20 AS act FROM d),
f AS (SELECT conv_id, turn, CASE WHEN act = 4 THEN 'user' ELSE role END AS role, CASE act WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN act = 3 THEN [1, 2] ELSE [1] END) AS part FROM h WHERE act <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), encode(text), part) AS place, rtrim(text, {_SPACES}) AS shown FROM f),
g AS (SELECT *, CASE WHEN shown = '' THEN 2 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 3 WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS f, left(role, 1) AS i FROM o),
n AS (SELECT *, place > 1 AND lag(i) OVER (PARTITION BY conv_id ORDER BY place) || i NOT IN ('su', 'ua', 'au') AS illegal FROM g),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 2) AS blank, count(*) FILTER (f = 3) AS duplicate, count(*) FILTER (f = 1) AS truncated, count(*) FILTER (illegal) AS illegal, list({{'f': f, 'i': i, 'role': role, 'text': text}} ORDER BY place) AS rows FROM n GROUP BY conv_id),
p AS (SELECT conv_id, rows, 0 AS k, {{'s0': {{'c': 0, 'a': ''}}, 's1': {_FAR}, 's2': {_FAR}, 's3': {_FAR}}} AS v FROM c
UNION ALL SELECT conv_id, rows, k + 1, {_edit()} FROM (SELECT conv_id, rows, k, rows[k + 1] AS r, {_insert("v")} AS w FROM p WHERE k < len(rows))),
e AS (SELECT conv_id, rows, least(v.s0, ({_insert("v")}).s3) AS best FROM p WHERE k = len(rows)),
x AS (SELECT conv_id, rows, best, 0 AS k, 0 AS pos, 0 AS s, CAST([] AS VARCHAR[]) AS lines FROM e
UNION ALL SELECT conv_id, rows, best, k + 1, pos + CASE WHEN l = 'I' THEN 0 ELSE 1 END, CASE WHEN l = 'D' THEN s WHEN l = 'K' THEN CASE r.i WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END WHEN s = 2 THEN 3 ELSE 2 END,
CASE l WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, r.role || ':' || r.text) WHEN 'R' THEN list_append(lines, wanted || ':' || r.text) ELSE list_append(lines, wanted || ':') END FROM (SELECT *, substr(best.a, k + 1, 1) AS l, rows[pos + 1] AS r, CASE WHEN s = 2 THEN 'assistant' ELSE 'user' END AS wanted FROM x WHERE k < length(best.a))),
z AS (SELECT conv_id, best, sha256(array_to_string(lines, chr(10))) AS sha FROM x WHERE k = length(best.a)), ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM ids LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM ids.conv_id"""

_DRAWS = ", ".join(f"CAST('0x' || substr(d, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))

INFILL = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents), h AS (SELECT *, {_DRAWS} FROM t),
f AS (SELECT *, CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM h),
p AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""


def oracle_sql() -> dict[str, str]:
    return {"op1_simhash": SIMHASH, "op5_suffixes": REPEATS, "op6_mixing": MIX, "op11_vectors": VECTORS, "op12_dialogues": DIALOGUES, "op13_infill": INFILL}
