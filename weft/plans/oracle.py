"""SQL that computes the same layers over rows (node, d, v), for checks in another engine."""

from __future__ import annotations

RELU, TANH, SIGMOID = "greatest(v, 0.0::DOUBLE)", "tanh(v)", "(1.0::DOUBLE / (1.0::DOUBLE + exp(-v)))"


def w(i, j, seed: int) -> str:
    return f"((((({i}) * 31 + ({j}) * 17 + {seed * 7}) % 13) - 6) / 8.0::DOUBLE)"


class Sql:
    """Common table expressions, one for each step."""

    def __init__(self):
        self.steps: list[tuple[str, str]] = []
        self.dim = 64

    def add(self, name: str, select: str) -> str:
        self.steps.append((name, select))
        return name

    def end(self, select: str) -> str:
        return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({s})" for n, s in self.steps) + "\n" + select

    def long(self, rel: str, keys: str = "node") -> str:
        return self.end(f"SELECT {keys}, d::INT AS dim, CAST(floor(v * 1e6 + 0.5) AS BIGINT) AS q FROM {rel}")

    # inputs
    def vectors(self, dim: int = 64, name: str = "x") -> str:
        self.dim = dim
        self.add(f"{name}_all", "SELECT vec_id::BIGINT AS node, label, unnest(range(0, 64)) AS d, unnest(embedding)::DOUBLE AS v FROM embeddings")
        return self.add(name, f"SELECT * FROM {name}_all WHERE d < {dim}")

    def ring(self, weighted: bool = True) -> str:
        weight = "((src + 2 * dst) % 4 + 1) / 4.0::DOUBLE" if weighted else "1.0::DOUBLE"
        self.add("e0", "SELECT DISTINCT vec_id::BIGINT AS src, ((vec_id * 7 + k * 131 + 1) % (SELECT count(*) FROM embeddings))::BIGINT AS dst FROM embeddings, range(5) t(k)")
        return self.add("e", f"SELECT src, dst, {weight} AS w FROM e0")

    def trade(self) -> None:
        self.add("t", "SELECT o_custkey::BIGINT AS src, (l_suppkey + 1000000)::BIGINT AS dst, l_discount, l_tax FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
        self.add("e", "SELECT src, dst, count(*)::DOUBLE AS w, avg(l_discount) AS e0, avg(l_tax) AS e1 FROM t GROUP BY src, dst")
        self.add("nodes", "SELECT c_custkey::BIGINT AS node FROM customer UNION ALL SELECT (s_suppkey + 1000000)::BIGINT FROM supplier")
        self.add("x", """SELECT node, d, CASE d WHEN 0 THEN a / 10000.0::DOUBLE WHEN 1 THEN n / 25.0::DOUBLE WHEN 2 THEN 1.0::DOUBLE ELSE s END AS v
            FROM (SELECT c_custkey::BIGINT AS node, c_acctbal AS a, c_nationkey AS n, 0.0::DOUBLE AS s FROM customer
                  UNION ALL SELECT (s_suppkey + 1000000)::BIGINT, s_acctbal, s_nationkey, 1.0::DOUBLE FROM supplier), range(4) r(d)""")

    # layers
    def dense(self, name: str, rel: str, outputs: int, seed: int, bias: int | None = None, act: str = "v") -> str:
        plus = f" + {w('i', 0, bias)}" if bias is not None else ""
        return self.add(name, f"SELECT node, d, {act} AS v FROM (SELECT node, i AS d, sum(v * {w('i', 'd', seed)}){plus} AS v FROM {rel}, range({outputs}) o(i) GROUP BY node, i)")

    def spread(self, name: str, found: str, dim: int, fill: str = "0.0::DOUBLE", nodes: str = "(SELECT DISTINCT node FROM x)") -> str:
        """Every node and place, with what was found or the fill."""
        return self.add(name, f"SELECT n.node, r.d, coalesce(f.v, {fill}) AS v FROM {nodes} n CROSS JOIN range({dim}) r(d) LEFT JOIN {found} f ON f.node = n.node AND f.d = r.d")

    def propagate(self, name: str, rel: str, dim: int, how: str = "sum", fill: str = "0.0::DOUBLE") -> str:
        self.add(f"{name}_m", f"SELECT e.dst AS node, r.d, {how}(r.v) AS v FROM e JOIN {rel} r ON r.node = e.src GROUP BY e.dst, r.d")
        return self.spread(name, f"{name}_m", dim, fill)

    def adjacency(self, name: str, rel: str, dim: int, edges: str = "e", transpose: bool = False) -> str:
        to, of = ("dst", "src") if transpose else ("src", "dst")
        self.add(f"{name}_m", f"SELECT a.{to} AS node, r.d, sum(a.w * r.v) AS v FROM {edges} a JOIN {rel} r ON r.node = a.{of} GROUP BY a.{to}, r.d")
        return self.spread(name, f"{name}_m", dim)

    def zip(self, name: str, a: str, b: str, value: str) -> str:
        """Two relations place by place: ``value`` of a.v and b.v."""
        return self.add(name, f"SELECT a.node, a.d, {value} AS v FROM {a} a JOIN {b} b ON a.node = b.node AND a.d = b.d")

    def each(self, name: str, rel: str, value: str) -> str:
        return self.add(name, f"SELECT node, d, {value} AS v FROM {rel}")

    def unit(self, name: str, rel: str) -> str:
        return self.add(name, f"SELECT node, d, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY node)), 1e-7) AS v FROM {rel}")

    # adjacency normalisation over nodes(node) and e(src, dst, w)
    def degrees(self, name: str = "deg", edges: str = "e", nodes: str = "nodes") -> str:
        return self.add(name, f"SELECT n.node, coalesce(sum(a.w), 0.0::DOUBLE) AS g FROM {nodes} n LEFT JOIN {edges} a ON a.src = n.node GROUP BY n.node")

    def normal(self, name: str, edges: str, degrees: str, symmetric: bool = True) -> str:
        p = lambda t: f"CASE WHEN {t}.g = 0 THEN 0.0::DOUBLE ELSE pow({t}.g, {-0.5 if symmetric else -1.0}) END"
        right = f" * {p('q')}" if symmetric else ""
        return self.add(name, f"SELECT a.src, a.dst, a.w * {p('p')}{right} AS w FROM {edges} a JOIN {degrees} p ON p.node = a.src JOIN {degrees} q ON q.node = a.dst")

    def edges(self, rel: str) -> str:
        return self.end(f"SELECT src, dst, CAST(floor(w * 1e6 + 0.5) AS BIGINT) AS q FROM {rel}")
