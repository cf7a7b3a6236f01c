"""SQL, for DuckDB, of the queries that SQL can express."""

from __future__ import annotations



def _mates(bits: int = 10) -> str:
    """The levels at which conversations of one opening are paired: x{k} has what is ranked, pairs are its odd rows."""
    out, left = [], "SELECT opening, conv_id FROM heads"
    for k, shift in enumerate(range(bits, 64 + bits, bits)):
        part = f"conv_id >> {shift}" if shift < 64 else "0"
        out.append(f"x{k} AS (SELECT opening, conv_id, row_number() OVER w AS r, lead(conv_id) OVER w AS mate FROM ({left}) WINDOW w AS (PARTITION BY opening, {part} ORDER BY conv_id))")
        left = f"SELECT opening, conv_id FROM x{k} WHERE r % 2 = 1 AND mate IS NULL"
    found = " UNION ALL ".join(f"SELECT conv_id, mate FROM x{k} WHERE r % 2 = 1 AND mate IS NOT NULL" for k in range(len(out)))
    return ",\n".join([*out, f"mates AS ({found})"])


CHAT = f"""
WITH t AS (SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM t),
heads AS (SELECT conv_id, max(turn) FILTER (role = 'assistant') AS cut, max(CASE WHEN k = 1 THEN role || chr(10) || text END) AS opening FROM k GROUP BY conv_id),
{_mates()},
speaking AS (SELECT conv_id, ('0x' || substr(md5(conv_id::VARCHAR), 1, 8))::BIGINT % greatest(1, (SELECT (2 * count(*) + 1023) // 1024 FROM heads WHERE cut IS NOT NULL)) AS part FROM heads WHERE cut IS NOT NULL),
near AS (SELECT conv_id, coalesce(lead(conv_id) OVER w, first_value(conv_id) OVER w) AS next FROM speaking WINDOW w AS (PARTITION BY part ORDER BY conv_id)),
odd AS (SELECT heads.conv_id, cut, mate, CASE WHEN next <> heads.conv_id THEN next END AS next FROM heads LEFT JOIN mates ON heads.conv_id = mates.conv_id LEFT JOIN near ON heads.conv_id = near.conv_id WHERE heads.conv_id NOT IN (SELECT mate FROM mates)),
pairs AS (SELECT conv_id AS chosen, coalesce(mate, next) AS rejected,
  CASE WHEN mate IS NOT NULL THEN 'shared' WHEN next IS NOT NULL THEN 'contrast' ELSE 'single' END AS kind, CASE WHEN mate IS NULL AND next IS NOT NULL THEN cut END AS cut FROM odd),
own AS (SELECT chosen AS pair_id, kind, cut, turn, role, text FROM t JOIN pairs ON conv_id = chosen),
lent AS (SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS n FROM t WHERE role = 'assistant') WHERE n = 1),
sides AS (SELECT pair_id, kind, 1 AS c, 0 AS r, turn, role, text FROM own
  UNION ALL SELECT chosen, kind, 0, 1, turn, role, text FROM t JOIN pairs ON conv_id = rejected AND kind = 'shared'
  UNION ALL SELECT pair_id, kind, 0, 1, turn, role, text FROM own WHERE kind = 'contrast' AND turn < cut
  UNION ALL SELECT chosen, kind, 0, 1, cut, 'assistant', text FROM lent JOIN pairs ON conv_id = rejected AND kind = 'contrast'),
merged AS (SELECT pair_id, kind, turn, role, text, max(c) AS c, max(r) AS r FROM sides GROUP BY ALL),
cuts AS (SELECT pair_id, coalesce(min(turn) FILTER (kind <> 'single' AND c + r < 2), max(turn) FILTER (kind = 'single' AND role = 'assistant')) AS cut FROM merged GROUP BY 1),
parts AS (SELECT m.*, cuts.cut, cuts.cut IS NULL OR turn < cuts.cut AS prompt FROM merged m JOIN cuts ON m.pair_id = cuts.pair_id),
named AS (SELECT *, 'prompt' AS segment FROM parts WHERE prompt UNION ALL SELECT *, 'chosen' FROM parts WHERE NOT prompt AND c = 1 UNION ALL SELECT *, 'rejected' FROM parts WHERE NOT prompt AND r = 1)
SELECT pair_id, kind, segment, turn, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered, (segment <> 'prompt' AND role = 'assistant')::INT AS loss, cut FROM named
"""


def _case(rules, what: str) -> str:
    """The longest rule that fits."""
    tests = [f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, what)}'" for r in sorted(rules, key=lambda r: (len(r.name), r.name), reverse=True)]
    return "CASE " + " ".join(tests) + " END"


def url_templates(rules, junk: str, most: int, longest: int = 48, children: int = 12, prevail: float = 0.25, weight: float = 8.0, z: float = 1.96, prior: float = 0.05, reject: float = 0.5) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    uuid = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
    rate = "(ab::DOUBLE / greatest(al, 1))"
    near = f"abs(pb::DOUBLE / greatest(pl, 1) - {rate}) <= {z!r}::DOUBLE * sqrt(greatest({rate} * (1 - {rate}), 0.01::DOUBLE) / greatest(pl, 1))"
    name = f"CASE WHEN ways = 1 THEN part WHEN kinds >= {children} AND most <= {prevail!r}::DOUBLE * total AND (pl = 0 OR {near}) THEN '*' WHEN pl > 0 AND {near} THEN '~' ELSE part END"
    out = [
        "r0 AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        "r1 AS (SELECT *, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS h FROM r0)",
        f"r2 AS (SELECT page_id, html, translate(h, '{upper}', '{lower}') AS host, regexp_extract(substr(coalesce(rest, ''), length(h) + 1), '^[^?#]*') AS path FROM r1)",
        f"r3 AS (SELECT *, {_case(rules, 'name')} AS rule, {_case(rules, 'verdict')} AS said, string_split(regexp_replace(path, '^/', ''), '/') AS parts FROM r2)",
        f"r4 AS (SELECT *, CASE WHEN said = 'block' THEN 1 WHEN said = 'allow' THEN 0 WHEN html IS NOT NULL THEN (len(regexp_extract_all(html, '{junk}')) >= {most})::INT END AS label, "
        f"list_transform(parts, lambda s: regexp_replace(translate(s, '{upper}', '{lower}'), '{uuid}', '{{uuid}}')) AS a FROM r3)",
        "r5 AS (SELECT *, list_transform(a, lambda s: CASE WHEN regexp_matches(s, '^[a-f]*[0-9]') AND regexp_matches(s, '^[0-9]*[a-f]') THEN regexp_replace(s, '^[0-9a-f]{8,}', '{hex}') ELSE s END) AS b FROM r4)",
        f"r6 AS (SELECT *, list_transform(list_transform(b, lambda s: regexp_replace(s, '[0-9]+', '{{n}}', 'g')), lambda s: CASE WHEN length(s) > {longest} THEN '{{long}}' ELSE s END) AS segments FROM r5)",
        "n0 AS (SELECT host, segments, count(*) AS n, count(label) AS labelled, coalesce(sum(label), 0)::BIGINT AS bad FROM r6 GROUP BY ALL)",
        f"share AS (SELECT (coalesce(sum(bad), 0)::DOUBLE + {prior * weight!r}::DOUBLE) / (coalesce(sum(labelled), 0)::DOUBLE + {weight!r}::DOUBLE) AS p FROM n0)",
        f"t AS (SELECT 0 AS level, n0.*, '' AS node, ((sum(bad) OVER (PARTITION BY host))::DOUBLE + p * {weight!r}::DOUBLE) / ((sum(labelled) OVER (PARTITION BY host))::DOUBLE + {weight!r}::DOUBLE) AS purity FROM n0, share\n"
        " UNION ALL SELECT level + 1, host, segments, n, labelled, bad, node || '/' || name, "
        f"CASE WHEN ways = 1 THEN purity ELSE (nb::DOUBLE + purity * {weight!r}::DOUBLE) / (nl::DOUBLE + {weight!r}::DOUBLE) END FROM (\n"
        "  SELECT *, sum(labelled) OVER (PARTITION BY host, node, name) AS nl, sum(bad) OVER (PARTITION BY host, node, name) AS nb FROM (\n"
        f"   SELECT *, {name} AS name FROM (\n"
        "    SELECT *, max(way) OVER w AS ways, max(way) FILTER (part IS NOT NULL) OVER w - (min(way) FILTER (part IS NOT NULL) OVER w) + 1 AS kinds, max(pn) FILTER (part IS NOT NULL) OVER w AS most, "
        "sum(n) FILTER (part IS NOT NULL) OVER w AS total, sum(labelled) FILTER (part IS NOT NULL) OVER w AS al, sum(bad) FILTER (part IS NOT NULL) OVER w AS ab FROM (\n"
        "     SELECT *, dense_rank() OVER (PARTITION BY host, node ORDER BY part NULLS FIRST) AS way, sum(n) OVER p AS pn, sum(labelled) OVER p AS pl, sum(bad) OVER p AS pb FROM (\n"
        "      SELECT *, segments[level + 1] AS part FROM t) WINDOW p AS (PARTITION BY host, node, part)) WINDOW w AS (PARTITION BY host, node))) WHERE part IS NOT NULL))",
    ]
    return "WITH RECURSIVE " + ",\n".join(out) + f"\nSELECT page_id, r6.host, path, rule, coalesce(said, CASE WHEN purity >= {reject!r} THEN 'block' ELSE 'allow' END) AS verdict, r6.host || node AS template, round(purity, 9) AS purity FROM r6 LEFT JOIN t ON r6.host = t.host AND r6.segments = t.segments AND t.level = len(t.segments)"
