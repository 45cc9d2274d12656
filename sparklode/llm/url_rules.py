"""URL filters: a broadcast trie over reversed host labels and path segments."""

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sparklode.llm.common import table

# Broadcast bound: a longer rule list is refused, not shipped.
MAX_RULES = 1_000_000


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path). Both are empty for NULL and for a text without ``://``."""
    mark = -1 if url is None else url.find("://")
    if mark < 0:
        return "", ""
    rest = url[mark + 3:]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    rest = rest[:end]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


class RuleTrie:
    """Rules ``(verdict, "host/path")``; the longest fitting rule wins, block on a tie.

    A host node has children by label, from the right. A node where rules end has a
    second trie over whole path segments; the last segment of a rule may be a part of
    the url's segment, so the ends of a node are kept by their length.
    """

    def __init__(self, rules):
        if len(rules) > MAX_RULES:
            raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are broadcast")
        self.root: dict = {}
        for verdict, text in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"neither allow nor block: {verdict}")
            host, slash, path = text.partition("/")
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".") if host else []):
                node = node.setdefault(("host", label), {})
            *whole, last = (slash + path).split("/")
            for segment in whole:
                node = node.setdefault(("path", segment), {})
            ends = node.setdefault("ends", {}).setdefault(len(last), {})
            rank = (len(text), verdict == "block", text, verdict)
            if last not in ends or ends[last] < rank:
                ends[last] = rank

    def find(self, host: str, path: str):
        """(rule, verdict) of the longest fitting rule, or None."""
        best = self._along(self.root, path)
        node = self.root
        for label in reversed(host.split(".")) if host else ():
            node = node.get(("host", label))
            if node is None:
                break
            best = max(best, self._along(node, path), key=lambda r: r or (-1,))
        return best and (best[2], best[3])

    @staticmethod
    def _along(node, path):
        best = None
        for segment in path.split("/"):
            for size, ends in node.get("ends", {}).items():
                rank = ends.get(segment[:size]) if size <= len(segment) else None
                if rank and (best is None or rank > best):
                    best = rank
            node = node.get(("path", segment))
            if node is None:
                break
        return best


def judge_urls(pages: DataFrame, rules, default: str = "allow",
               url: str = "url", keep=("page_id",)) -> DataFrame:
    """host, path, rule and verdict per page, beside the ``keep`` columns.

    A page that no rule fits (NULL url, no host) gets a NULL rule and ``default``.
    Repeated rows stay; other columns, whatever their names, are not read.
    """
    trie = pages.sparkSession.sparkContext.broadcast(RuleTrie(rules))
    keep = list(keep)
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)

    def judge(batches):
        find = trie.value.find
        for b in batches:
            parts = [split_url(u) for u in b.column(len(keep)).to_pylist()]
            found = [find(h, p) for h, p in parts]
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(len(keep))] + [
                    pa.array([h for h, _ in parts], pa.string()),
                    pa.array([p for _, p in parts], pa.string()),
                    pa.array([f and f[0] for f in found], pa.string()),
                    pa.array([f[1] if f else default for f in found], pa.string())],
                names=[*keep, "host", "path", "rule", "verdict"])

    return pages.select(*keep, url).mapInArrow(
        judge, f"{kinds}, host string, path string, rule string, verdict string")


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
         ("allow", "com/fr/"), ("block", "com/de/")]


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), RULES)


_RULE_ROWS = ", ".join(
    f"('{verdict}', '{text}', '{text.partition('/')[0]}', '/{text.partition('/')[2]}')"
    for verdict, text in RULES)

OP9_SQL = rf"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0
    THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, row_number() OVER () AS n,
    translate(CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, 1, strpos(rest, '/') - 1)
      ELSE rest END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path
  FROM cut),
rules(verdict, rule, r_host, r_path) AS (VALUES {_RULE_ROWS}),
fits AS (
  SELECT n, rule, verdict, row_number() OVER (PARTITION BY n ORDER BY length(rule) DESC,
    verdict DESC) AS pick
  FROM parts JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host))
    AND starts_with(path, r_path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.n = p.n AND f.pick = 1
"""
