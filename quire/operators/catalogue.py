"""The theme catalogue: keyed merge, order, families, and publishing differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as T

FIELDS = ["name", "activity", "language", "description", "updated_at"]


def upsert(catalogue: DataFrame, inputs: DataFrame) -> DataFrame:
    """Merge inputs(id, fields…, ord) into catalogue(id, fields…, ord).

    Input value, else the previous one, else the default. Known rows keep their place
    (`grp` 0), new ones follow in order of arrival (`grp` 1).
    """
    latest = inputs.groupBy("id").agg(F.min("ord").alias("_in"), *[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(f"_{c}") for c in FIELDS])
    j = catalogue.join(latest, "id", "full_outer")
    default = {"name": F.replace("id", F.lit("_"), F.lit(" ")), "activity": F.lit(""), "language": F.lit("es"),
               "description": F.lit(""), "updated_at": F.lit(None).cast("string")}
    known, touched = F.col("ord").isNotNull(), F.col("_in").isNotNull()
    cols = [F.when(touched, F.coalesce(f"_{c}", c, default[c])).otherwise(F.col(c)).alias(c) for c in FIELDS]
    return j.select("id", *cols, F.lit(None).cast("string").alias("screenshot"),
                    F.when(known, 0).otherwise(1).alias("grp"), F.coalesce("ord", "_in").alias("ord"))


def remove(catalogue: DataFrame, ids: DataFrame) -> DataFrame:
    return catalogue.join(ids.select("id"), "id", "left_anti")


def order(themes: DataFrame, saved: DataFrame) -> DataFrame:
    """Adds `sort_key`: the saved position, or one past every position; ties keep `ord`."""
    s = saved.select("id", F.col("ord").alias("_saved")).groupBy("id").agg(F.max("_saved").alias("sort_key"))
    return themes.join(s, "id", "left").withColumn("sort_key", F.coalesce("sort_key", F.lit(2**53 - 1)))


def listing(builtin: DataFrame, user: DataFrame, selectable: bool = False) -> DataFrame:
    """Built-in themes (`src` 0), then the user's; a later registration of an id wins but
    keeps the first one's place: the order is (src, place_src, ord). `base` is no choice."""
    both = builtin.withColumn("src", F.lit(0)).unionByName(user.withColumn("src", F.lit(1)))
    seq = F.struct("src", "ord")
    cols = [c for c in both.columns if c not in ("id", "ord")]
    one = both.groupBy("id").agg(F.max_by(F.struct(*cols), seq).alias("v"), F.min(seq).alias("place"))
    out = one.select("id", "v.*", F.col("place.src").alias("place_src"), F.col("place.ord").alias("ord"))
    return out.filter("id <> 'base'") if selectable else out


def family_name(name: Column) -> Column:
    """The name without its parenthesised language words."""
    from .markers import rewrite_matches
    par = r"\s*\([^()]*\)"

    def one(m: Column) -> Column:
        word = T.normalize_label(F.regexp_extract(m, r"\(([^()]*)\)", 1))
        return F.when(word.isin(fixed.LANG_TOKENS), " ").otherwise(m)

    out = F.when(name.contains("("), rewrite_matches(T.strip(name), par, one)).otherwise(T.strip(name))
    return T.strip(F.regexp_replace(out, r"\s{2,}", " "))


def families(themes: DataFrame) -> DataFrame:
    """Adds family `key`, `family`, `family_ord` and `rank`: reading order is
    (family_ord, rank, ord).

    Members stay rows: only the first position and name per family are aggregated, so a
    family of any size never becomes one value.
    """
    rank = F.create_map(*[F.lit(x) for kv in fixed.LANG_RANK.items() for x in kv])
    t = themes.withColumn("_f", family_name(F.col("name"))).withColumn("key", T.normalize_label(F.col("_f")))
    t = t.withColumn("rank", F.coalesce(F.try_element_at(rank, F.lower(F.coalesce("language", F.lit("")))), F.lit(9)))
    fam = t.groupBy("key").agg(F.min("ord").alias("family_ord"), F.min_by("_f", "ord").alias("family"))
    return t.drop("_f").join(fam, "key")


def _json(c: str) -> Column:
    """A string column as a JSON value."""
    arr = F.to_json(F.array(c))
    return F.when(F.col(c).isNull(), "null").otherwise(F.substring(arr, F.lit(2), F.length(arr) - 2))


def json_rows(catalogue: DataFrame) -> DataFrame:
    """(grp, ord, json): one serialised entry per row, keys in fixed order; `updatedAt`
    only where known."""
    parts = [F.concat(F.lit(f'"{c}":'), _json(c)) for c in ("id", "name", "activity", "language", "description", "screenshot")]
    stamp = F.when(F.col("updated_at").isNotNull(), F.concat(F.lit('"updatedAt":'), _json("updated_at")))
    return catalogue.select("grp", "ord", F.concat(F.lit("{"), F.concat_ws(",", *parts, stamp), F.lit("}")).alias("json"))


def parse_catalogue(texts: DataFrame, col: str = "value") -> DataFrame:
    """Catalogue rows from JSON texts; an unreadable one has none."""
    schema = ("struct<themes:array<struct<id:string,name:string,activity:string,language:string,"
              "description:string,screenshot:string,updatedAt:string>>>")
    keys = [c for c in texts.columns if c != col]
    e = texts.select(*keys, F.posexplode_outer(F.from_json(col, schema)["themes"]).alias("ord", "t"))
    return e.filter("t is not null").select(*keys, "ord", "t.*").withColumnRenamed("updatedAt", "updated_at")


def config_fields(configs: DataFrame) -> DataFrame:
    """(theme_id, language, title, version) from configuration texts(theme_id, xml)."""
    lang = F.lower(T.strip(F.regexp_extract("xml", r"(?is)<language[^>]*>(.*?)</language>", 1)))
    title = T.strip(F.regexp_extract("xml", r"(?is)<title>(.*?)</title>", 1))
    version = F.regexp_extract("xml", r"(?i)<version>\s*(\d+)\s*</version>", 1)
    return configs.select("theme_id", F.when(lang.isin(fixed.KNOWN_LANGS), lang).alias("language"),
                          F.when(title != "", title).alias("title"), F.when(version != "", version.cast("int")).alias("version"))


def manifest_diff(new_files: DataFrame, existing: DataFrame, config_sha: str | None = None) -> DataFrame:
    """(path, action, sha): upserts of new_files(theme_id, path, sha) and deletions of
    existing(theme_id, path) that were not written; the catalogue file comes along."""
    clean = F.regexp_replace("path", "^/+", "")
    full = F.concat(F.lit(fixed.THEMES_DIR + "/"), F.col("theme_id"), F.lit("/"), F.col("path"))
    up = new_files.withColumn("path", clean)
    gone = existing.withColumn("path", clean).join(up.select("theme_id", "path"), ["theme_id", "path"], "left_anti")
    out = up.select(full.alias("path"), F.lit("upsert").alias("action"), "sha").unionByName(
        gone.select(full.alias("path"), F.lit("delete").alias("action"), F.lit(None).cast("string").alias("sha")))
    if config_sha is None:
        return out
    spark = new_files.sparkSession
    row = spark.createDataFrame([(fixed.THEMES_CONFIG_PATH, "upsert", config_sha)], "path string, action string, sha string")
    return out.unionByName(row)
