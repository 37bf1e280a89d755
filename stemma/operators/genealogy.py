"""Family links: from columns of lists to typed links, ancestors, descendants and layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.functions.text import name_from_id, relation
from stemma.util import broadcast_if_small, cut, keep_first

FAMILY = ("father", "mother", "partners", "children", "siblings")


def id_list(c: Column) -> Column:
    """The trimmed parts of a comma list, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def relatives(people: DataFrame, key: str = "person_lookup") -> DataFrame:
    """key, relatives: the ids of all family columns, in their order."""
    return people.filter(F.length(F.trim(key)) > 0).select(F.trim(key).alias(key), F.concat(*[id_list(F.col(c)) for c in FAMILY]).alias("relatives"))


def link_id(a: Column, kind: Column, b: Column) -> Column:
    """'a→kind→b'; of symmetric kinds the lesser id comes first."""
    even = kind.isin("spouse-of", "sibling-of", "half-sibling-same-father", "half-sibling-same-mother")
    return F.concat_ws("→", F.when(even, F.least(a, b)).otherwise(a), kind, F.when(even, F.greatest(a, b)).otherwise(b))


def family_links(people: DataFrame, key: str = "person_lookup", male: tuple[str, ...] = ("male",), female: tuple[str, ...] = ("female",)) -> DataFrame:
    """id, person_from, person_to, type of the family columns: fathers and mothers point at the row's person; a parent of unknown gender gives its children no link.

    Ids that no row has are passed over, as are links to oneself; of equal links the first stays (by seq, then the column).
    """
    rows = people.filter(F.length(F.trim(key)) > 0).withColumns({"me": F.trim(key), "g": F.lower(F.trim("gender"))})
    parent = F.when(F.col("g").isin(*male), "father-of").when(F.col("g").isin(*female), "mother-of")
    kinds = {"father": (0, F.lit("father-of"), False), "mother": (1, F.lit("mother-of"), False), "partners": (2, F.lit("spouse-of"), True), "siblings": (3, F.lit("sibling-of"), True), "children": (4, parent, True)}

    def listed(c: str) -> Column:
        o, kind, out = kinds[c]
        return F.transform(id_list(F.col(c)), lambda x: F.struct(F.lit(o).alias("o"), kind.alias("type"), F.lit(out).alias("out"), x.alias("other")))

    lists = F.concat(*map(listed, kinds))
    one = rows.select("me", "seq", F.posexplode(lists).alias("i", "x")).select("me", "seq", "i", "x.*").filter("type is not null")
    known = rows.select(F.col("me").alias("other")).distinct()
    ok = one.join(known, "other", "left_semi").filter("me <> other")
    a, b = F.when(F.col("out"), F.col("me")).otherwise(F.col("other")), F.when(F.col("out"), F.col("other")).otherwise(F.col("me"))
    edges = ok.select(link_id(a, F.col("type"), b).alias("id"), a.alias("person_from"), b.alias("person_to"), "type", "seq", "i")
    return keep_first(edges, ["id"], ["seq", "i"]).select("id", "person_from", "person_to", "type")


def family_stats(people: DataFrame, key: str = "person_lookup", male: tuple[str, ...] = ("male",), female: tuple[str, ...] = ("female",)) -> DataFrame:
    """One row: persons, dangling (references that no row has), skipped (known children of parents of unknown gender)."""
    rows = people.filter(F.length(F.trim(key)) > 0).withColumns({"me": F.trim(key), "g": F.lower(F.trim("gender"))})

    def listed(c: str) -> Column:
        return F.transform(id_list(F.col(c)), lambda x: F.struct(F.lit(c).alias("c"), x.alias("other")))

    refs = rows.select("me", "g", F.explode(F.concat(*map(listed, FAMILY))).alias("x"))
    known = rows.select(F.col("me").alias("other"), F.lit(True).alias("known")).distinct()
    j = refs.select("g", "x.c", "x.other").join(known, "other", "left")
    lost = j.agg(F.count(F.when(F.col("known").isNull(), 1)).alias("dangling"), F.count(F.when(F.col("known") & (F.col("c") == "children") & ~F.coalesce(F.col("g").isin(*male, *female), F.lit(False)), 1)).alias("skipped"))
    return rows.agg(F.countDistinct("me").alias("persons")).join(F.broadcast(lost))


def supplement_links(rows: DataFrame, ids: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """id, person_from, person_to, type of rows (source, type, target, seq) of the allowed kinds (raw: type) whose ends both have an id (external_id, id); first of equal ones."""
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.lower(F.trim("type")))
    a = ids.select(F.col("external_id").alias("source"), F.col("id").alias("person_from"))
    b = ids.select(F.col("external_id").alias("target"), F.col("id").alias("person_to"))
    j = rows.withColumn("type", kind).filter("type is not null").join(a, "source").join(b, "target").filter("person_from <> person_to")
    return keep_first(j.withColumn("id", link_id(F.col("person_from"), F.col("type"), F.col("person_to"))), ["id"], ["seq"]).select("id", "person_from", "person_to", "type")


def without_divine(links: DataFrame, ids: tuple[str, ...]) -> DataFrame:
    return links.filter(~F.col("person_from").isin(*ids) & ~F.col("person_to").isin(*ids))


def parents(links: DataFrame) -> DataFrame:
    """child, father, mother, parent (the father, else the mother), both: the first of each kind."""
    first = lambda k: F.min_by("person_from", F.when(F.col("type") == k, F.struct("seq", "person_from")))
    p = links.filter(F.col("type").isin("father-of", "mother-of")).groupBy(F.col("person_to").alias("child")).agg(first("father-of").alias("father"), first("mother-of").alias("mother"))
    return p.withColumns({"parent": F.coalesce("father", "mother"), "both": F.col("father").isNotNull() & F.col("mother").isNotNull()})


def match_names(labels: DataFrame, persons: DataFrame) -> DataFrame:
    """id, person_id of labels (id, label) such as 'Name (son of Parent)': the persons (id, name, parent_name) of that name, whose parent must agree if one is named; null if nobody."""
    low = lambda c: F.lower(F.trim(c))
    parent = F.nullif(low(F.regexp_extract("label", r"(?i)\((?:son|daughter) of ([^)]*)\)", 1)), F.lit(""))
    asked = labels.select("id", low(F.regexp_replace("label", r"\s*\(.*$", "")).alias("k"), parent.alias("p"))
    known = persons.select(F.col("id").alias("person_id"), low(F.col("name")).alias("k"), low(F.col("parent_name")).alias("q"))
    hits = asked.join(known, "k").filter("p is null or p = q").select("id", "person_id")
    return labels.select("id").distinct().join(hits, "id", "left")


def many_fathers(links: DataFrame) -> DataFrame:
    return links.filter("type = 'father-of'").groupBy(F.col("person_to").alias("child")).agg(F.countDistinct("person_from").alias("fathers")).filter("fathers > 1")


def neighbours(rows: DataFrame, a: str, b: str) -> DataFrame:
    """a, b in both directions, distinct."""
    one = rows.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null")
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def below(links: DataFrame, roots: DataFrame, stride: int = 8) -> DataFrame:
    """root, node, depth of everyone below the roots (node) by father-of and mother-of, each once at the least depth; safe on cycles.

    A round plans ``stride`` generations in one job and is cut off once; rounds go on until nobody new is found.
    """
    kids = cut(links.filter(F.col("type").isin("father-of", "mother-of")).select(F.col("person_from").alias("node"), F.col("person_to").alias("kid")).distinct())
    kids = broadcast_if_small(kids)
    seen = cut(roots.select(F.col("node").alias("root"), "node").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    depth = 0
    while True:
        step, found = frontier.select("root", "node"), None
        for k in range(depth + 1, depth + stride + 1):
            step = step.join(kids, "node").select("root", F.col("kid").alias("node")).distinct()
            found = step.withColumn("depth", F.lit(k)) if found is None else found.unionByName(step.withColumn("depth", F.lit(k)))
        new = cut(found.groupBy("root", "node").agg(F.min("depth").alias("depth")).join(seen.select("root", "node"), ["root", "node"], "left_anti"))
        seen = seen.unionByName(new)
        depth += stride
        frontier = new.filter(F.col("depth") == depth)  # whoever is new at the last generation; nearer ones had their turn
        if frontier.isEmpty():
            return seen


def ancestry(parents_: DataFrame, starts: DataFrame, maternal: bool = False) -> DataFrame:
    """node, path (from the furthest ancestor down to the node) of starts (node): each step to the preferred parent, else to the other; it ends before anyone comes twice.

    Everyone has one step, so that walks double each round: as many rounds as the longest walk's length has binary digits.
    """
    first, second = ("mother", "father") if maternal else ("father", "mother")
    up = cut(parents_.select(F.col("child").alias("node"), F.coalesce(first, second).alias("up")).filter("node is not null and up is not null"))
    # path goes upwards here; at is its end while it may go on
    walks = cut(up.select("node", F.array_distinct(F.array("node", "up")).alias("path"), F.when(F.col("node") != F.col("up"), F.col("up")).alias("at")))
    ended: list[DataFrame] = []
    while True:
        on = walks.select(F.col("node").alias("at"), F.col("path").alias("next"), F.col("at").alias("then"))
        for e in ended:
            on = on.unionByName(e.select(F.col("node").alias("at"), F.col("path").alias("next"), F.lit(None).cast("string").alias("then")))
        longer = F.concat("path", F.slice("next", F.lit(2), F.size("next")))
        # whoever comes again, comes with all that follows: the distinct ones are the walk up to there
        step = walks.filter("at is not null").join(on, "at", "left").withColumn("both", F.when(F.col("next").isNull(), F.col("path")).otherwise(F.array_distinct(longer)))
        goes = F.col("next").isNotNull() & (F.size("both") == F.size(longer))
        ended.append(walks.filter("at is null").select("node", "path"))
        walks = cut(step.select("node", F.col("both").alias("path"), F.when(goes, F.col("then")).alias("at")))
        if walks.isEmpty():
            break
    found = ended[0]
    for e in ended[1:]:
        found = found.unionByName(e)
    return starts.select("node").distinct().join(found, "node", "left").select("node", F.coalesce(F.reverse("path"), F.array("node")).alias("path"))


def names(links: DataFrame, persons: DataFrame) -> DataFrame:
    """id, name of everyone in the links: from persons (id, name), else made from the id."""
    ids = links.select(F.col("person_from").alias("id")).union(links.select("person_to")).filter("id is not null").distinct()
    known = persons.groupBy("id").agg(F.max("name").alias("__name"))
    return ids.join(known, "id", "left").select("id", F.coalesce("__name", name_from_id(F.col("id"))).alias("name"))


def find_root(wanted: str, named: DataFrame, persons: DataFrame, counts: DataFrame) -> DataFrame:
    """id of whom a text means, at most one row: an id of the tree; of a person; of the name in the tree with most below (counts: id, below; first on ties); of any person of the name."""
    low = wanted.strip().lower()
    a = named.filter(F.col("id") == wanted).select("id", F.lit(0).alias("o"), F.lit(0).cast("long").alias("n"))
    b = persons.filter(F.col("id") == wanted).select("id", F.lit(1).alias("o"), F.lit(0).cast("long").alias("n"))
    c = named.filter(F.lower("name") == low).join(counts, "id", "left").select("id", F.lit(2).alias("o"), (-F.coalesce("below", F.lit(0))).cast("long").alias("n"))
    d = persons.filter(F.lower("name") == low).select("id", F.lit(3).alias("o"), F.lit(0).cast("long").alias("n"))
    return a.unionByName(b).unionByName(c).unionByName(d).orderBy("o", "n", "id").limit(1).select("id")


def layout(tree: DataFrame, x0: float = 20, column: float = 200, y0: float = 20, row: float = 60) -> DataFrame:
    """node, depth, path, x, y, leaf of one tree (node, path array, depth): leaves in depth-first order on rows, a parent midway between its first and last child.

    The rank of a leaf is a window over the paths; y then goes up one generation at a time.
    """
    kids = tree.filter("depth > 0").select(F.get("path", F.col("depth") - 1).alias("node")).distinct().withColumn("inner", F.lit(True))
    t = tree.join(kids, "node", "left").withColumn("leaf", F.col("inner").isNull())
    leaves = t.filter("leaf").withColumn("y", F.lit(float(y0)) + (F.row_number().over(Window.orderBy("path")) - 1) * row)  # one drawing
    placed = cut(leaves.select("node", "path", "depth", "y"))
    inner = t.filter("not leaf")
    deepest = inner.agg(F.max("depth")).first()[0]
    for d in range(deepest if deepest is not None else -1, -1, -1):
        ends = placed.filter(F.col("depth") == d + 1).groupBy(F.get("path", F.lit(d)).alias("node")).agg(F.min_by("y", "path").alias("a"), F.max_by("y", "path").alias("b"))
        level = inner.filter(F.col("depth") == d).join(ends, "node").select("node", "path", "depth", ((F.col("a") + F.col("b")) / 2).alias("y"))
        placed = cut(placed.unionByName(level))
    return placed.join(t.select("node", "leaf"), "node").withColumn("x", F.lit(float(x0)) + F.col("depth") * column)


def rail(tree: DataFrame, branches: DataFrame, max_depth: int = 2) -> DataFrame:
    """node, depth, branch, relation, ord of the first generations of one tree: a branch (node, branch) is one's own down to the first generation and inherited below."""
    b = branches.select(F.col("node").alias("__at"), "branch")
    rows = tree.filter(F.col("depth") <= max_depth).withColumn("__at", F.get("path", F.least(F.col("depth"), F.lit(1)))).join(b, "__at", "left")
    return rows.select("node", "depth", "branch", relation(F.col("depth")).alias("relation"), F.row_number().over(Window.orderBy("path")).alias("ord"))
