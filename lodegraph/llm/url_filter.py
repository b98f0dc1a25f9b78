"""URL filters by a path-template tree for each host.

The segments of a URL's path lead down its host's tree. Variable segments are generalised:
numbers, dates, and long hexadecimal names become typed wildcards at once, and below each node
the names that fewer than ``LEAST`` URLs have become ``*``. So do names of a share of under ``SHARE`` of the node's, but for
those of ``PAGES`` pages or ``LABELLED`` labelled ones, on a host of any size, and those that a Hoeffding test tells from the pooled other names.
Of the names that stay, those are merged whose branches are statistically alike: neither the
kinds of segment that follow nor the labelled shares of good pages differ by more than the sum of their Hoeffding
bounds (each name, most frequent first, joins the first group it is alike to). What is left at the
ends of paths are the templates, such as ``/de|en/{n}.html``. Levels are grown for as long as any node has ``LEAST`` URLs that go on, as
no name further down can have more; whatever is deeper is generalised in one step.

A template's purity is its share of pages labelled good, smoothed by ``WEIGHT`` pseudo-pages of its host's share,
which is smoothed likewise by that of all labelled pages. Templates of a purity under
``PURITY`` are rejected, and their pages with them. Labels are of documents, and page_id only numbers
the pages: a page's document is the last number of its URL's path (7817 for /en/7817.html?page=2).

URLs are first counted by host and typed path, so the tree is grown over distinct shapes, level by
level; a level costs a few grouped sums. The names that stay below a node are merged in blocks of about ``BLOCK``
(one, but for a node of more), and of several blocks only the groups come together in one place, of which there are few as those in a block
are unlike. Neither a large host nor one of a million names is ever collected. The label of a group of over
``SPELLED`` names has the first of these and the number of the others.

Result of ``judge``: for every row ``page_id``, ``host``, ``template``, ``n_pages``, ``n_labelled``,
``purity`` (6 digits) and ``rejected``. ``keep`` gives the rows that are not rejected, whole.

Defined cases. The scheme, user, port, query and fragment of a URL, empty segments and the case of the host play
no part. A null or empty URL, and one without a host, has no template; its purity is null and it is not
rejected. A page_id that is no integer counts as null. Paths may have any number of segments. Rows that repeat are answered
each; they count as pages each. Paths without a number have no label. Of repeated labels the lowest counts, null
ones not at all. Equal counts go by the alphabet. A purity of exactly ``PURITY`` is kept. Other columns play no part. Without any label
nothing is rejected and purity is null. Empty tables give an empty result.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._frames import cut, id_of, may_be_in, same_columns

LEAST, SHARE = 5, 0.02
#: Pages, or labelled ones, with which a name keeps its branch on a host of any size.
PAGES, LABELLED = 100, 20
#: Names of a node that are merged together at once, and names that a merged branch's label spells out.
BLOCK, SPELLED = 4096, 50
ALPHA = 0.05
WEIGHT, PURITY = 10.0, 0.5


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def document_of(url: Column) -> Column:
    """The doc_id of the page's document: the last number of the path, but for a file's extension."""
    return F.regexp_extract(F.regexp_replace(path_of(url), r"\.[A-Za-z][A-Za-z0-9]{0,4}/*$", ""), r"([0-9]+)[^0-9]*$", 1).try_cast("long")


def kinds(url: Column) -> Column:
    """The path's segments, variable ones as their types."""
    names = F.filter(F.split(path_of(url), "/"), lambda s: s != "")

    def kind(s: Column) -> Column:
        number = F.regexp_replace(s, r"^[0-9]+(\.[A-Za-z0-9]{1,5})?$", "{n}$1")
        date = F.regexp_replace(number, r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$", "{date}")
        return F.regexp_replace(date, r"^(?=[^.]*[0-9])[0-9A-Fa-f-]{8,}(\.[A-Za-z0-9]{1,5})?$", "{hex}$1")

    return F.transform(names, kind)


def alike(n: int, a: dict[str, int], m: int, b: dict[str, int]) -> bool:
    bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
    return all(abs(a.get(k, 0) / n - b.get(k, 0) / m) <= bound for k in a.keys() | b.keys())


def groups(names: dict[str, tuple[int, int, int, dict[str, int]]]) -> list[list[str]]:
    """Names (with pages, labelled, good and what follows) that are merged."""
    return [sorted(members) for members, _ in _grouped(names)]


def _grouped(names: dict[str, tuple[int, int, int, dict[str, int]]]) -> list[tuple[list[str], list]]:
    made: list[tuple[list[str], list]] = []
    for name in sorted(names, key=lambda s: (-names[s][0], s)):
        n, labelled, good, after = names[name]
        for members, total in made:
            if alike(n, after, total[0], total[3]) and (not labelled or not total[1] or alike(labelled, {"": good}, total[1], {"": total[2]})):
                members.append(name)
                for i, x in enumerate((n, labelled, good)):
                    total[i] += x
                for k, x in after.items():
                    total[3][k] = total[3].get(k, 0) + x
                break
        else:
            made.append(([name], [n, labelled, good, dict(after)]))
    return made


def _totals(table) -> dict[str, tuple[int, int, int, dict[str, int]]]:
    names: dict[str, tuple[int, int, int, dict[str, int]]] = {}
    for name, after, n, labelled, good in zip(*(table.column(c).to_pylist() for c in ("name", "after", "n", "labelled", "good"))):
        old = names.get(name, (0, 0, 0, {}))
        names[name] = (old[0] + n, old[1] + labelled, old[2] + good, old[3] | {after: old[3].get(after, 0) + n})
    return names


def _block(key, table):
    """Groups of a block's names: each name with the least of its group, and that one with the group's sums, by what follows."""
    rows = []
    for members, (_, labelled, good, after) in _grouped(_totals(table)):
        head = min(members)
        rows += [(name, head, None, None, None, None) for name in members]
        rows += [(None, head, kind, n, labelled if not i else 0, good if not i else 0) for i, (kind, n) in enumerate(sorted(after.items()))]
    host, node, _ = (k.as_py() for k in key)
    cols = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.string()] * 3 + [pa.int64()] * 3)]
    return pa.table([pa.array([host] * len(rows), pa.string()), pa.array([node] * len(rows), pa.string()), *cols, pa.array([table.column("blocks")[0].as_py()] * len(rows), pa.int64())], ["host", "node", "member", "name", "after", "n", "labelled", "good", "blocks"])


def _heads(key, table):
    """The blocks' groups merged: the least names of those, and of the group that each is in."""
    names = _totals(table)
    made = groups(names) if table.column("blocks")[0].as_py() > 1 else [[name] for name in names]
    rows = [(name, g[0]) for g in made for name in g]
    k = len(rows)
    return pa.table({"at_host": pa.array([key[0].as_py()] * k, pa.string()), "at_node": pa.array([key[1].as_py()] * k, pa.string()), "head": pa.array([r[0] for r in rows], pa.string()), "first": pa.array([r[1] for r in rows], pa.string())})


def _stay(counts: DataFrame, whole: DataFrame) -> DataFrame:
    """host, node and name of those that keep a branch: by share, by pages or labels, or as what follows them or their
    share of good pages is unlike that of the node's other names, pooled."""
    c = math.sqrt(0.5 * math.log(2 / ALPHA))
    at = ["host", "node"]
    sums = counts.groupBy(*at, "name").agg(F.sum("n").alias("many"), F.sum("labelled").alias("l"), F.sum("good").alias("g")).where(F.col("many") >= LEAST)
    pool = counts.groupBy(*at).agg(F.sum("n").alias("all_n"), F.sum("labelled").alias("all_l"), F.sum("good").alias("all_g"))
    sums = cut(sums.join(whole, at).join(pool, at))

    def unlike(part: Column, size: Column, every: Column, of: Column) -> Column:
        rest = of - size
        return F.when((size > 0) & (rest > 0), F.abs(part / size - (every - part) / rest) > c * (1 / F.sqrt(size) + 1 / F.sqrt(rest))).otherwise(False)

    col = F.col
    sure = (col("many") >= SHARE * col("whole")) | (col("many") >= PAGES) | (col("l") >= LABELLED) | unlike(col("g"), col("l"), col("all_g"), col("all_l"))
    open_ = sums.where(~sure)
    # What follows a name is held against what follows the rest, also where the name has none of it.
    kinds_ = counts.groupBy(*at, "after").agg(F.sum("n").alias("all_k")).join(pool.select(*at, "all_n").withColumnRenamed("all_n", "of_n"), at).where(col("all_k") > c * F.sqrt("of_n")).drop("of_n")
    none = open_.join(kinds_, at).join(counts.select(*at, "name", "after", "n"), [*at, "name", "after"], "left").where(unlike(F.coalesce("n", F.lit(0)), col("many"), col("all_k"), col("all_n")))
    own = open_.join(counts.select(*at, "name", "after", "n"), [*at, "name"]).join(counts.groupBy(*at, "after").agg(F.sum("n").alias("all_k")), [*at, "after"]).where(unlike(col("n"), col("many"), col("all_k"), col("all_n")))
    names = [*at, "name"]
    return sums.where(sure).select(*names).union(none.select(*names)).union(own.select(*names)).distinct()


def _labels(counts: DataFrame) -> DataFrame:
    """at_host, at_node, name and the label of its branch; names are merged in blocks, and the blocks' groups after that."""
    at = ["host", "node"]
    blocks = counts.groupBy(*at).agg(F.ceil(F.count_distinct("name") / BLOCK).alias("blocks"))
    known = counts.join(blocks, at).withColumn("block", F.pmod(F.xxhash64("name"), F.col("blocks")))
    made = cut(known.groupBy(*at, "block").applyInArrow(_block, "host string, node string, member string, name string, after string, n long, labelled long, good long, blocks long"))
    heads = made.where("member IS NULL").groupBy(*at).applyInArrow(_heads, "at_host string, at_node string, head string, first string")
    members = made.where("member IS NOT NULL").select("host", "node", F.col("member").alias("name"), F.col("name").alias("of"))
    named = cut(members.join(heads, (F.col("host") == F.col("at_host")) & (F.col("node") == F.col("at_node")) & (F.col("of") == F.col("head"))).select("at_host", "at_node", "name", "first"))
    order = Window.partitionBy("at_host", "at_node", "first").orderBy("name")
    ranked = named.withColumn("place", F.row_number().over(order))
    spelled = ranked.groupBy("at_host", "at_node", "first").agg(F.array_join(F.sort_array(F.collect_list(F.when(F.col("place") <= SPELLED, F.col("name")))), "|").alias("text"), (F.count("*") - SPELLED).alias("more"))
    label = F.when(F.col("more") > 0, F.concat("text", F.lit("|+"), F.col("more").cast("string"))).otherwise(F.col("text"))
    return named.join(spelled.select("at_host", "at_node", "first", label.alias("label")), ["at_host", "at_node", "first"]).select("at_host", "at_node", "name", "label")


def grow(shapes: DataFrame) -> DataFrame:
    """shapes: host, kinds, n, labelled, good. The same rows with their templates."""
    deepest = shapes.agg(F.max(F.size("kinds"))).first()[0] or 0
    state = shapes.withColumn("node", F.lit(""))
    for depth in range(deepest):
        here = F.try_element_at("kinds", F.lit(depth + 1))
        after = F.coalesce(F.try_element_at("kinds", F.lit(depth + 2)), F.lit("/"))
        step = state.where(here.isNotNull()).select("host", "node", here.alias("name"), F.when(after.rlike(r"^(\{|/$)"), after).otherwise("name").alias("after"), "n", "labelled", "good")
        sums = [F.sum(c).alias(c) for c in ("n", "labelled", "good")]
        if step.groupBy("host", "node").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST).isEmpty():
            rest = F.transform(F.slice("kinds", depth + 1, F.greatest(F.size("kinds"), F.lit(1))), lambda k: F.concat(F.lit("/"), F.when(k.rlike(r"^\{"), k).otherwise("*")))
            state = state.withColumn("node", F.concat("node", F.array_join(rest, "")))
            break
        counts = cut(step.where(~F.col("name").rlike(r"^\{")).groupBy("host", "node", "name", "after").agg(*sums))
        whole = step.groupBy("host", "node").agg(F.sum("n").alias("whole"))
        labels = cut(_labels(counts.join(_stay(counts, whole), ["host", "node", "name"])))
        joined = state.withColumn("here", here).join(labels, (F.col("host") == F.col("at_host")) & (F.col("node") == F.col("at_node")) & (F.col("here") == F.col("name")), "left")
        part = F.coalesce("label", F.when(F.col("here").rlike(r"^\{"), F.col("here")).otherwise("*"))
        state = cut(joined.select("host", "kinds", "n", "labelled", "good", F.when(F.col("here").isNull(), F.col("node")).otherwise(F.concat("node", F.lit("/"), part)).alias("node")))
    return state.withColumn("template", F.when(F.col("node") == "", "/").otherwise(F.col("node"))).drop("node")


def _verdicts(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """of_host, of_kinds, template, n_pages, n_labelled and purity of each shape of URL."""
    url = pages["url"].cast("string")
    rows = pages.select(host_of(url).alias("host"), kinds(url).alias("kinds"), document_of(url).alias("document"))
    known = labels.select(id_of(labels).alias("known_id"), labels["quality"].try_cast("int").alias("quality")).where("known_id IS NOT NULL AND quality IS NOT NULL").groupBy("known_id").agg((F.min("quality") > 0).cast("int").alias("is_good"))
    labelled = rows.where("host IS NOT NULL").join(known, rows["document"] == known["known_id"], "left")
    shapes = cut(labelled.groupBy("host", "kinds").agg(F.count("*").alias("n"), F.count("is_good").alias("labelled"), F.coalesce(F.sum("is_good"), F.lit(0)).alias("good")))
    grown = cut(grow(shapes))
    per_host = grown.groupBy("host").agg(F.sum("labelled").alias("host_labelled"), F.sum("good").alias("host_good"))
    every = shapes.agg(F.sum("labelled"), F.sum("good")).first()
    share = every[1] / every[0] if every[0] else None
    prior = (F.col("host_good") + WEIGHT * F.lit(share).cast("double")) / (F.col("host_labelled") + WEIGHT)
    templates = grown.groupBy("host", "template").agg(F.sum("n").alias("n_pages"), F.sum("labelled").alias("n_labelled"), F.sum("good").alias("good")).join(per_host, "host")
    templates = templates.withColumn("purity", F.round((F.col("good") + WEIGHT * prior) / (F.col("n_labelled") + WEIGHT), 6))
    verdicts = grown.select("host", "kinds", "template").join(templates.select("host", "template", "n_pages", "n_labelled", "purity"), ["host", "template"])
    return verdicts.withColumnsRenamed({"host": "of_host", "kinds": "of_kinds"})


def judge(pages: DataFrame, labels: DataFrame) -> DataFrame:
    url = pages["url"].cast("string")
    rows = pages.select(id_of(pages, "page_id").alias("page_id"), host_of(url).alias("host"), kinds(url).alias("kinds"))
    verdicts = _verdicts(pages, labels)
    out = rows.join(verdicts, (F.col("host") == F.col("of_host")) & (F.col("kinds") == F.col("of_kinds")), "left")
    return out.select("page_id", "host", "template", "n_pages", "n_labelled", "purity", F.coalesce(F.col("purity") < PURITY, F.lit(False)).alias("rejected"))


def keep(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The pages whose URL's template is not rejected, with the columns they came with. Each row goes by its own URL. Only
    rows whose URL's shape may be a rejected one, by a bitmap, are moved."""
    bad = cut(_verdicts(pages, labels).where(F.col("purity") < PURITY).select("of_host", "of_kinds"))
    shape = F.xxhash64(host_of(pages["url"].cast("string")), kinds(pages["url"].cast("string")))
    may_be = may_be_in(bad.select(F.xxhash64("of_host", "of_kinds").alias("shape")).distinct())(shape)
    # One row, so that no column of the table meets one of ours.
    url = F.col("whole").getField("url").cast("string")
    maybe = pages.where(may_be).select(F.struct(*same_columns(pages)).alias("whole"))
    spared = maybe.join(bad, (host_of(url) == F.col("of_host")) & (kinds(url) == F.col("of_kinds")), "left_anti")
    return pages.where(~may_be).unionByName(spared.select("whole.*"))
