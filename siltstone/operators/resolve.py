"""Resolution of references to files, as equi-joins on candidate paths and names.

Every reference asks by (repository, source file, target name); equal asks are resolved once. Path
rules make an ordered list of candidate paths per ask, the first that exists wins. What is left is
looked up by symbol name: a single definition elsewhere, else the only one in the same folder, else
the only one below the same top folder, else all of them. The counts that decide this come from
tables aggregated per (name), (name, folder) and (name, top folder), so no pairs of asks and
definitions are formed; only ``targets`` expands the ambiguous asks, whose result is all definers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.text import normalize_path

_KEY = ["repo", "path", "language", "target_name"]


def _candidates() -> F.Column:
    d = t.dirname("path")
    name = "btrim(target_name, ' \t\n\r\f')"
    at = f"if({d} = '.', '', concat({d}, '/'))"
    last = f"regexp_extract({name}, '[^.]*$', 0)"
    slashed = f"replace({name}, '.', '/')"
    absolute = f"array(concat({at}, {last}, '.py'), concat({slashed}, '.py'), concat({slashed}, '/__init__.py'), concat({at}, {last}, '/__init__.py'))"
    dots = f"length(regexp_extract({name}, '^[.]+', 0))"
    rest = f"replace(substring({name}, {dots} + 1), '.', '/')"
    folders = f"filter(split({d}, '/'), x -> x <> '.')"
    base = f"array_join(slice({folders}, 1, greatest(size({folders}) - {dots} + 1, 0)), '/')"
    up = f"if({base} = '', '', concat({base}, '/'))"
    relative = f"if({rest} = '', array(concat({up}, '__init__.py')), array(concat({up}, {rest}, '.py'), concat({up}, {rest}, '/__init__.py')))"
    script = f"transform(array('.ts', '.tsx', '.js', '.jsx', '/index.ts', '/index.js'), x -> concat(if(startswith(target_name, '/'), target_name, concat({at}, target_name)), x))"
    parts = "split(substring(target_name, 8), '::')"
    module = f"array_join(if(size({parts}) > 1, slice({parts}, 1, size({parts}) - 1), {parts}), '/')"
    above = f"if({t.dirname(d)} = '.', '', concat({t.dirname(d)}, '/'))"
    one = "substring_index(substring(target_name, 8), '::', 1)"
    none = "cast(array() as array<string>)"
    return F.expr(f"""case
        when language = 'python' and startswith({name}, '.') then {relative}
        when language = 'python' then {absolute}
        when language in ('typescript', 'javascript') and (startswith(target_name, '.') or startswith(target_name, '/')) then {script}
        when language = 'rust' and startswith(target_name, 'crate::') then array(concat('src/', {module}, '.rs'), concat('src/', {module}, '/mod.rs'))
        when language = 'rust' and startswith(target_name, 'super::') then array(concat({above}, {one}, '.rs'), concat({above}, {one}, '/mod.rs'))
        when language = 'java' then array(concat(replace(target_name, '.', '/'), '.java'))
        else {none} end""")


def asks_of(refs: DataFrame) -> DataFrame:
    """The distinct asks of references without a target file."""
    return refs.filter("target_file is null and target_name is not null").select(*_KEY).distinct()


def by_path(asks: DataFrame, files: DataFrame) -> DataFrame:
    """Asks whose first existing candidate path is a file: the key and ``target``."""
    paths = files.select(F.col("repo").alias("_r"), F.col("path").alias("_p"))
    each = asks.select(*_KEY, F.posexplode(_candidates()).alias("pos", "cand")).withColumn("cand", normalize_path("cand"))
    hits = each.join(paths, (F.col("repo") == F.col("_r")) & (F.col("cand") == F.col("_p")))
    return hits.groupBy(*_KEY).agg(F.min_by("cand", "pos").alias("target"))


def by_class(asks: DataFrame, files: DataFrame) -> DataFrame:
    """Java asks met by a file of the class's name: the one whose path holds the import's folder, else the first by path."""
    java = asks.filter("language = 'java'").withColumn("_file", F.expr("concat(regexp_extract(target_name, '[^.]*$', 0), '.java')"))
    named = files.select(F.col("repo").alias("_r"), F.expr(t.basename("path")).alias("_b"), F.col("path").alias("_p"))
    hits = java.join(named, (F.col("repo") == F.col("_r")) & (F.col("_file") == F.col("_b")))
    folder = "replace(regexp_replace(target_name, '[.][^.]*$', ''), '.', '/')"
    inside = F.expr(f"if(contains(target_name, '.') and {folder} <> '' and contains(_p, {folder}), _p, null)")
    return hits.groupBy(*_KEY).agg(F.coalesce(F.min(inside), F.min("_p")).alias("target"))


def _folders(asks: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Go packages and Java wildcards as ``key, dir``: the folder whose files, and the folder below which the files are asked for."""
    go = asks.filter("language = 'go'")
    folders = files.select("repo", F.expr(t.dirname("path")).alias("dir")).distinct()
    # A folder is found by its whole path or by what follows any slash in it.
    suffixes = folders.select(
        F.col("repo").alias("_r"), "dir", F.explode(F.expr("transform(sequence(1, size(split(dir, '/'))), i -> array_join(slice(split(dir, '/'), i, size(split(dir, '/'))), '/'))")).alias("_s")
    )
    hits = go.join(suffixes, (F.col("repo") == F.col("_r")) & (F.col("target_name") == F.col("_s"))).select(*_KEY, "dir", F.expr("dir = target_name").alias("exact"))
    # A whole path wins over suffixes; there is one such folder at most.
    whole = hits.withColumn("whole", F.max("exact").over(Window.partitionBy(*_KEY)))
    packages = whole.filter("exact or not whole").select(*_KEY, "dir")
    star = asks.filter("language = 'java' and endswith(target_name, '.*')").select(*_KEY, F.expr("replace(substring(target_name, 1, length(target_name) - 2), '.', '/')").alias("dir"))
    return packages, star


def _in_folder(files: DataFrame) -> DataFrame:
    """``_r, _d, target``: every file in its folder."""
    return files.select(F.col("repo").alias("_r"), F.expr(t.dirname("path")).alias("_d"), F.col("path").alias("target"))


def _below(files: DataFrame) -> DataFrame:
    """``_r, _d, target``: every Java file in each folder above it."""
    above = "transform(sequence(1, size(split(path, '/')) - 1), i -> array_join(slice(split(path, '/'), 1, i), '/'))"
    return files.filter("endswith(path, '.java') and contains(path, '/')").select(F.col("repo").alias("_r"), F.explode(F.expr(above)).alias("_d"), F.col("path").alias("target"))


def _meet(asked: DataFrame, held: DataFrame) -> DataFrame:
    return asked.join(held, (F.col("repo") == F.col("_r")) & (F.col("dir") == F.col("_d")))


def by_folder(asks: DataFrame, files: DataFrame) -> DataFrame:
    """Go packages and Java wildcards: the key, how many files are meant (``n_targets``) and the first, ``target``; none is expanded."""

    def total(held: DataFrame) -> DataFrame:
        return held.groupBy("_r", "_d").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("target"))

    packages, star = _folders(asks, files)
    met = _meet(packages, total(_in_folder(files))).unionByName(_meet(star, total(_below(files))))
    return met.groupBy(*_KEY).agg(F.sum("n").alias("n_targets"), F.min("target").alias("target"))


def files_of_folders(asks: DataFrame, files: DataFrame) -> DataFrame:
    """The same asks expanded: the key and ``target`` for every file of the folders asked for."""
    packages, star = _folders(asks, files)
    return _meet(packages, _in_folder(files)).unionByName(_meet(star, _below(files))).select(*_KEY, "target")


def _lookup_name() -> F.Column:
    return F.expr("""case
        when language = 'python' and not startswith(btrim(target_name), '.') then regexp_extract(btrim(target_name), '[^.]*$', 0)
        when language = 'rust' then substring_index(target_name, '::', -1)
        when language = 'java' then regexp_extract(target_name, '[^.]*$', 0)
        when language in ('python', 'typescript', 'javascript', 'go') then null
        else target_name end""")


def _top(p: str) -> str:
    return f"if(contains({p}, '/'), substring_index({p}, '/', 1), '')"


def definitions(symbols: DataFrame) -> DataFrame:
    """Definitions as a bag: ``repo, name, path, n``; a file that defines a name twice counts twice."""
    return symbols.filter("name is not null").groupBy("repo", "name", "path").agg(F.count(F.lit(1)).alias("n"))


def by_symbol(asks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Asks looked up by symbol name: the key, ``lookup``, ``n_targets`` and, if only one, ``target``.

    A file's own definitions don't count, except for Java. The totals of a name meet one row per folder
    that asks for it, and the asks meet these rows by (name, folder), so the askers of a hot name spread.
    """
    bag = definitions(symbols)

    def totals(by: list[str], tag: str) -> DataFrame:
        g = bag.withColumn("dir", F.expr(t.dirname("path"))).withColumn("top", F.expr(_top("path"))).groupBy("repo", "name", *by)
        out = g.agg(F.sum("n").alias(f"{tag}_n"), F.min("path").alias(f"{tag}_lo"), F.max("path").alias(f"{tag}_hi"))
        return out.select(*[F.col(c).alias(f"_{tag}_{c}") for c in ("repo", "name", *by)], f"{tag}_n", f"{tag}_lo", f"{tag}_hi")

    asked = asks.withColumn("lookup", _lookup_name()).filter("lookup is not null").withColumn("_dir", F.expr(t.dirname("path")))
    same = lambda tag: (F.col("repo") == F.col(f"_{tag}_repo")) & (F.col("lookup") == F.col(f"_{tag}_name"))
    places = asked.select("repo", "lookup", "_dir", F.expr(_top("path")).alias("_top")).distinct()
    places = places.join(totals([], "all"), same("all"))
    places = places.join(totals(["dir"], "dir"), same("dir") & (F.col("_dir") == F.col("_dir_dir")), "left")
    places = places.join(totals(["top"], "top"), same("top") & (F.col("_top") == F.col("_top_top")), "left")
    places = places.select(F.col("repo").alias("_pl_repo"), F.col("lookup").alias("_pl_name"), F.col("_dir").alias("_pl_dir"), *[f"{g}_{x}" for g in ("all", "dir", "top") for x in ("n", "lo", "hi")])
    a = asked.join(places, same("pl") & (F.col("_dir") == F.col("_pl_dir")))
    own = bag.select(F.col("repo").alias("_own_repo"), F.col("name").alias("_own_name"), F.col("path").alias("_own_path"), F.col("n").alias("own_n"))
    a = a.join(own, same("own") & (F.col("path") == F.col("_own_path")) & (F.col("language") != "java"), "left")

    def left(tag: str) -> str:
        return f"(coalesce({tag}_n, 0) - coalesce(own_n, 0))"

    def only(tag: str) -> str:  # with one definition left, the group holds it and perhaps the asking file
        return f"if(own_n is not null and {tag}_lo = path, {tag}_hi, {tag}_lo)"

    target = f"""case when {left('all')} = 1 then {only('all')}
        when language <> 'java' and {left('dir')} = 1 then {only('dir')}
        when language <> 'java' and {left('top')} = 1 then {only('top')} end"""
    out = a.filter(f"{left('all')} > 0").withColumn("target", F.expr(target))
    n = F.when(F.col("target").isNotNull(), F.lit(1)).otherwise(F.expr(left("all"))).cast("bigint")
    return out.select(*_KEY, "lookup", n.alias("n_targets"), "target")


def resolve(files: DataFrame, refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """How every ask is resolved: the key, ``how``, ``n_targets``, ``target`` (the only or first one), ``lookup``.

    ``how`` is ``path``, ``class``, ``folder``, ``symbol`` or ``ambiguous``; unresolved asks (external
    names) are left out. Ambiguous asks are not expanded here. Every way is tried for every ask it is
    open to, and the first in this order that gives anything is taken; nothing is written on the way.
    """
    asks = asks_of(refs)
    one, none = F.lit(1).cast("bigint"), F.lit(None).cast("string")

    def way(order: int, found: DataFrame, how, n_targets=one, lookup=none) -> DataFrame:
        return found.select(*_KEY, F.struct(F.lit(order).alias("order"), how.alias("how"), n_targets.alias("n_targets"), F.col("target").alias("target"), lookup.alias("lookup")).alias("way"))

    names = by_symbol(asks, symbols)
    ways = (
        way(0, by_path(asks, files), F.lit("path"))
        .unionByName(way(1, by_class(asks, files), F.lit("class")))
        .unionByName(way(2, by_folder(asks, files), F.lit("folder"), F.col("n_targets")))
        .unionByName(way(3, names, F.when(F.col("target").isNull(), "ambiguous").otherwise("symbol"), F.col("n_targets"), F.col("lookup")))
    )
    return ways.groupBy(*_KEY).agg(F.min_by("way", F.col("way.order")).alias("w")).select(*_KEY, "w.how", "w.n_targets", "w.target", "w.lookup")


def targets(resolved: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Every (ask, target file): the key and ``target``, folders and ambiguous asks expanded."""
    single = resolved.filter("how in ('path', 'class', 'symbol')").select(*_KEY, "target")
    folders = files_of_folders(resolved.filter("how = 'folder'").select(*_KEY), files)
    bag = definitions(symbols).select(F.col("repo").alias("_r"), F.col("name").alias("_n"), F.col("path").alias("_p"))
    many = resolved.filter("how = 'ambiguous'").join(bag, (F.col("repo") == F.col("_r")) & (F.col("lookup") == F.col("_n")))
    every = many.filter("language = 'java' or _p <> path").select(*_KEY, F.col("_p").alias("target"))
    return single.unionByName(folders).unionByName(every)
