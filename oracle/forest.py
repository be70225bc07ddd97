"""The isolation forest grown in SQL: level by level, every choice by the same hash."""

from __future__ import annotations

from collections.abc import Sequence

# Multipliers of the hash and the numbers of its decisions.
M1, M2, SALT, TREE, NODE = 2246822507, 3266489909, 2654435761, 2246822519, 3266489917
SAMPLE, KEPT, ASKED, CUT = 1, 2, 3, 4
WORD = 4294967296


def mixed(src: str) -> str:
    for step in ("xor(h, h >> 16)", f"(h * {M1}::UBIGINT) % {WORD}", "xor(h, h >> 13)", f"(h * {M2}::UBIGINT) % {WORD}", "xor(h, h >> 16)"):
        src = f"SELECT * REPLACE ({step} AS h) FROM ({src})"
    return src


def drawn(src: str, node: str, salt: int) -> str:
    """Rows of ``src`` (with seed and tree) and their hash ``h`` for a node expression."""
    out = mixed(f"SELECT *, ((seed + {salt * SALT}) % {WORD})::UBIGINT AS h FROM ({src})")
    out = mixed(f"SELECT * REPLACE ((h + tree::UBIGINT * {TREE}::UBIGINT) % {WORD} AS h) FROM ({out})")
    return mixed(f"SELECT * REPLACE ((h + ({node})::UBIGINT * {NODE}::UBIGINT) % {WORD} AS h) FROM ({out})")


def forest(src: str, name: str, cols: Sequence[str], trees: int = 800, size: int = 256, share: float = 0.8, seed: int = 42, depth: int = 8) -> list[tuple[str, str]]:
    """CTEs; ``name`` has (entity, pos, path) from ``src`` with entity, pos, train_point and the columns."""
    long = " UNION ALL ".join(f"SELECT entity, pos, train_point, {i} AS f, coalesce({c}, 0)::DOUBLE AS x FROM {src}" for i, c in enumerate(cols))
    kept = max(1, int(share * len(cols)))
    p = lambda x: f"{name}_{x}"
    out = [
        (p("long"), long),
        (p("ids"), f"SELECT entity, pos, row_number() OVER (PARTITION BY entity ORDER BY pos) - 1 AS r, count(*) OVER (PARTITION BY entity) AS n FROM {src} WHERE train_point = 1"),
        (p("train"), f"SELECT i.entity, i.r, l.f, l.x FROM {p('ids')} i JOIN {p('long')} l USING (entity, pos)"),
        (p("one"), f"SELECT entity, any_value(n) AS n, CAST('0x' || substr(sha256(entity || ':{seed}'), 1, 8) AS BIGINT) AS seed, least(any_value(n), {size}) AS size, ceil(log2(greatest(least(any_value(n), {size}), 2)))::INT AS depth FROM {p('ids')} GROUP BY entity"),
        (p("trees"), f"SELECT o.*, t.tree FROM {p('one')} o, range({trees}) t(tree)"),
        (p("kept"), f"SELECT entity, tree, f FROM ({drawn(f'SELECT entity, seed, tree, f FROM ' + p('trees') + f', range({len(cols)}) g(f)', 'f', KEPT)}) QUALIFY row_number() OVER (PARTITION BY entity, tree ORDER BY h DESC, f) <= {kept}"),
        (p("s0"), f"SELECT entity, seed, depth, tree, 1 AS node, ((h * n::UBIGINT) >> 32)::BIGINT AS r FROM ({drawn(f'SELECT entity, seed, depth, n, tree, j FROM ' + p('trees') + ', LATERAL (SELECT unnest(range(size)) AS j)', 'j', SAMPLE)})"),
    ]
    for level in range(depth + 1):
        s, n = p(f"s{level}"), p(f"n{level}")
        held = f"SELECT entity, seed, tree, node, depth, count(*) AS held FROM {s} GROUP BY ALL"
        out.append((p(f"h{level}"), held))
        if level == depth:
            out.append((n, f"SELECT *, NULL::INT AS f, NULL::DOUBLE AS cut FROM {p(f'h{level}')}"))
            break
        spread = f"SELECT s.entity, s.seed, s.tree, s.node, k.f, min(x) AS low, max(x) AS high FROM {s} s JOIN {p('kept')} k USING (entity, tree) JOIN {p('train')} t ON t.entity = s.entity AND t.r = s.r AND t.f = k.f WHERE s.depth > {level} GROUP BY ALL HAVING max(x) > min(x)"
        best = f"SELECT entity, seed, tree, node, f, low, high FROM ({drawn(spread, 'node * 1024 + f', ASKED)}) QUALIFY row_number() OVER (PARTITION BY entity, tree, node ORDER BY h DESC, f) = 1"
        out.append((p(f"c{level}"), f"SELECT entity, tree, node, f, low + (h::DOUBLE / {WORD}.0) * (high - low) AS cut FROM ({drawn(best, 'node', CUT)})"))
        out.append((n, f"SELECT h.*, c.f, c.cut FROM {p(f'h{level}')} h LEFT JOIN {p(f'c{level}')} c USING (entity, tree, node)"))
        out.append((p(f"s{level + 1}"), f"SELECT s.entity, s.seed, s.depth, s.tree, 2 * s.node + CAST(t.x > c.cut AS INT) AS node, s.r FROM {s} s JOIN {p(f'c{level}')} c USING (entity, tree, node) JOIN {p('train')} t ON t.entity = s.entity AND t.r = s.r AND t.f = c.f"))
    usual = "CASE WHEN held <= 1 THEN 0.0 WHEN held = 2 THEN 1.0 ELSE 2.0 * (ln(held - 1.0) + 0.5772156649015329) - 2.0 * (held - 1.0) / held END"
    out.append((p("w0"), f"SELECT b.entity, b.pos, t.tree, 1 AS node FROM {src} b JOIN {p('trees')} t USING (entity)"))
    parts = []
    for level in range(depth + 1):
        w, n = p(f"w{level}"), p(f"n{level}")
        out.append((p(f"m{level}"), f"SELECT w.*, n.f, n.cut, n.held FROM {w} w LEFT JOIN {n} n USING (entity, tree, node)"))
        parts.append(f"SELECT entity, pos, {level} * 1000000 + round(coalesce({usual}, 0) * 1000000)::BIGINT AS path FROM {p(f'm{level}')} WHERE f IS NULL")
        if level < depth:
            out.append((p(f"w{level + 1}"), f"SELECT m.entity, m.pos, m.tree, 2 * m.node + CAST(l.x > m.cut AS INT) AS node FROM {p(f'm{level}')} m JOIN {p('long')} l USING (entity, pos, f) WHERE m.f IS NOT NULL"))
    return [*out, (name, f"SELECT entity, pos, sum(path) / ({trees} * 1000000.0) AS path FROM (" + " UNION ALL ".join(parts) + ") GROUP BY entity, pos")]


def scores(src: str, name: str, cols: Sequence[str], cov: float = 25.0, contamination: float = 0.06) -> list[tuple[str, str]]:
    """``src`` with if_score and if_anomaly_point of the forest."""
    n = "least(sum(train_point) OVER (PARTITION BY entity), 256)"
    raw = f"SELECT s.*, -pow(2.0, -p.path / CASE WHEN {n} > 2 THEN 2.0 * (ln({n} - 1.0) + 0.5772156649015329) - 2.0 * ({n} - 1.0) / {n} ELSE 1.0 END) AS raw FROM {src} s LEFT JOIN {name}_p p USING (entity, pos)"
    cut = f"SELECT *, CASE WHEN coalesce(coverage_pct, 0) >= {cov} THEN raw - quantile_cont(CASE WHEN train_point = 1 THEN raw END, {contamination}) OVER (PARTITION BY entity) END AS if_score FROM ({raw})"
    return [*forest(src, f"{name}_p", cols), (name, f"SELECT * EXCLUDE (raw), CAST(coalesce(if_score < 0, false) AS INTEGER) AS if_anomaly_point FROM ({cut})")]
