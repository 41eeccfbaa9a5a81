"""What a package is: mappings that documents establish, how they are recorded, and corrections by people."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.functions.text import project_name

# Kinds of mapping, and the package's columns that each owns (feedstocks are rows of their own).
OWNED = {
    "source_repository": ("source_repository_url",),
    "release_ecosystem": ("primary_purl", "primary_type"),
    "conda_artifact": ("conda_purl",),
    "feedstock": (),
    "cross_ecosystem": ("alternative_purls", "cpes"),
}
ESTABLISHED = "established"
_FEEDSTOCK = "-feedstock"

_held = lambda c: F.coalesce(c, F.lit("")) != ""
_yes = lambda c: F.coalesce(F.col(c), F.lit(False))


def resolution(identities: DataFrame) -> DataFrame:
    """package_id, confidence, the owned columns, feedstocks (name and url), an outcome for each kind, and detail: what two documents establish.

    identities: package_id and canonical_name; what the package holds (source_outcome,
    source_repository_url, release_outcome, primary_purl, primary_type and
    has_feedstocks); feedstocks, the names that the index of feedstocks lists for it;
    asked, whether the project index answered, and if so found and repository_url,
    that project's repository in normal form.

    An index that can't be asked never lowers what was established: its two kinds
    keep what the package holds, and are errors where it holds nothing.  Recorded
    feedstocks keep their mapping when the index falls silent.  The claim is
    inventory-derived if a repository, a project or feedstocks are established, else
    unmapped; documents never verify.
    """
    asked, found = _yes("asked"), _yes("asked") & _yes("found")
    keeps = {"source": (F.col("source_outcome") == ESTABLISHED) & _held(F.col("held_url")), "release": (F.col("release_outcome") == ESTABLISHED) & _held(F.col("held_purl"))}
    keeps = {k: ~asked & F.coalesce(v, F.lit(False)) for k, v in keeps.items()}
    url = F.when(asked, F.coalesce("repository_url", F.lit(""))).when(keeps["source"], F.col("held_url")).otherwise("")
    listed = F.coalesce("feedstocks", F.array().cast("array<string>"))
    builds = (F.size(listed) > 0) | _yes("has_feedstocks")
    outcome = lambda good, kept: F.when(asked, F.when(good, ESTABLISHED).otherwise("not_found")).when(kept, ESTABLISHED).otherwise("error")
    built = F.when(builds, ESTABLISHED).otherwise("not_found")
    outcomes = {
        "source_repository": outcome(_held(F.col("repository_url")), keeps["source"]),
        "release_ecosystem": outcome(found, keeps["release"]),
        "conda_artifact": built,
        "feedstock": built,
        "cross_ecosystem": F.lit("not_found"),
    }
    repository = lambda n: F.when(F.endswith(n, F.lit(_FEEDSTOCK)), n).otherwise(F.concat(n, F.lit(_FEEDSTOCK)))
    rows = F.transform(listed, lambda n: F.struct(repository(n).alias("name"), F.concat(F.lit("https://github.com/conda-forge/"), repository(n)).alias("url")))
    detail = F.concat_ws(
        "; ",
        F.when(~asked, "the project index could not be asked").when(~found, "the project index has no such project").when(~_held(F.col("repository_url")), "the project names no repository that can be read"),
        F.when(keeps["source"] | keeps["release"], "what was established before is kept"),
        F.when(F.size(listed) == 0, F.when(builds, "the feedstock index lists none, recorded ones are kept").otherwise("the feedstock index lists none")),
    )
    known = identities.withColumnsRenamed({"source_repository_url": "held_url", "primary_purl": "held_purl", "primary_type": "held_type"})
    return known.select(
        "package_id",
        F.when(_held(url) | found | builds, "inventory-derived").otherwise("unmapped").alias("confidence"),
        url.alias("source_repository_url"),
        F.when(found, F.concat(F.lit("pkg:pypi/"), project_name(F.col("canonical_name")))).when(keeps["release"], F.col("held_purl")).otherwise("").alias("primary_purl"),
        F.when(found, "pypi").when(keeps["release"], F.col("held_type")).otherwise("").alias("primary_type"),
        F.when(builds, F.concat(F.lit("pkg:conda/"), F.lower(F.trim("canonical_name")))).otherwise("").alias("conda_purl"),
        rows.alias("feedstocks"),
        *[c.alias(f"{k}_outcome") for k, c in outcomes.items()],
        detail.alias("detail"),
    )


def recorded(packages: DataFrame, resolutions: DataFrame, at) -> DataFrame:
    """packages after resolutions (one of a package at most), and downgrade_refused.

    A mapping's columns are only written where it is established, so that what was
    found stays when a later look finds nothing.  A verified identity keeps its
    confidence, and the refusal is told.  resolved_at moves only with another column:
    it says when the identity changed, not when somebody looked.
    """
    owned = {c: kind for kind, columns in OWNED.items() for c in columns if c in packages.columns and c in resolutions.columns}
    new = resolutions.select("package_id", F.struct(F.col("confidence"), *owned, *[f"{kind}_outcome" for kind in OWNED]).alias("new"))
    both = packages.join(new, "package_id", "left")
    refused = F.coalesce((F.col("confidence") == "verified") & (F.col("new.confidence") != "verified"), F.lit(False))
    written = {c: F.when(F.col(f"new.{kind}_outcome") == ESTABLISHED, F.col(f"new.{c}")).otherwise(F.col(c)) for c, kind in owned.items()}
    written["confidence"] = F.when(refused | F.col("new").isNull(), F.col("confidence")).otherwise(F.col("new.confidence"))
    changed = reduce(lambda a, b: a | b, [~v.eqNullSafe(F.col(c)) for c, v in written.items()])
    written["resolved_at"] = F.when(changed, F.lit(at)).otherwise(F.col("resolved_at"))
    return both.select(*[written.get(c, F.col(c)).alias(c) for c in packages.columns], refused.alias("downgrade_refused"))


def mappings(held: DataFrame, resolutions: DataFrame, at) -> DataFrame:
    """package_id, kind, outcome, resolved_at: one row of each kind for each package resolved, in place of what was held; other packages' rows stay."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_outcome").alias("outcome")) for k in OWNED])
    new = resolutions.select("package_id", F.explode(kinds).alias("m")).select("package_id", "m.kind", "m.outcome", F.lit(at).alias("resolved_at"))
    return held.join(resolutions.select("package_id"), "package_id", "left_anti").select(*new.columns).unionByName(new)


def feedstocks(held: DataFrame, resolutions: DataFrame) -> DataFrame:
    """package_id, name, url: what was held, none removed, with new urls and names where the mapping is established."""
    named = resolutions.where(F.col("feedstock_outcome") == ESTABLISHED).select("package_id", F.explode("feedstocks").alias("f")).select("package_id", F.trim("f.name").alias("name"), F.col("f.url").alias("new_url"))
    new = named.groupBy("package_id", "name").agg(F.max("new_url").alias("new_url"))
    return held.join(new, ["package_id", "name"], "full_outer").select("package_id", "name", F.coalesce("new_url", "url").alias("url"))


def corrected(packages: DataFrame, corrections: DataFrame, names: Sequence[str] = ("canonical_name", "display_name")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Packages after people's corrections; an audit row for each that was made; and those refused with the reason.

    packages: package_id, canonical_name, display_name, confidence, resolved_at.
    corrections: correction_id, package_id, actor, permitted, reason, canonical_name
    (blank: leave it), display_name (null: leave it; empty: none), decided_at.

    A correction verifies the identity.  Those about one package are made by
    decided_at and correction_id, and each audit row has the values before and after
    it.  A name is refused while another package holds it, or an earlier correction
    gives it to one.  resolved_at never moves back, and not without a change.
    """
    name, shown = names
    wanted = F.nullif(F.trim(name), F.lit(""))
    asked = corrections.withColumns({"_wanted": wanted, "_turn": F.struct("decided_at", "correction_id")})
    stored = packages.select("package_id", F.struct(name, shown, "confidence", "resolved_at").alias("was"))
    holder = packages.select(F.col(name).alias("_wanted"), F.col("package_id").alias("holder"))  # names are unique
    fault = (
        F.when(~_yes("permitted"), "not permitted")
        .when(F.trim(F.coalesce("reason", F.lit(""))) == "", "no reason")
        .when(F.col("was").isNull(), "no such package")
        .when(F.col("holder").isNotNull() & (F.col("holder") != F.col("package_id")), "name taken")
    )
    checked = asked.join(stored, "package_id", "left").join(holder, "_wanted", "left").withColumn("refused", fault)
    claims = checked.where(F.col("refused").isNull() & F.col("_wanted").isNotNull()).groupBy("_wanted").agg(F.min_by("package_id", "_turn").alias("claimant"))
    checked = checked.join(claims, "_wanted", "left").withColumn("refused", F.coalesce("refused", F.when(F.col("claimant") != F.col("package_id"), "name taken")))
    made = checked.where(F.col("refused").isNull())
    turns = W.partitionBy("package_id").orderBy("_turn")
    so_far = turns.rowsBetween(W.unboundedPreceding, W.currentRow)
    after = {name: F.coalesce(F.last("_wanted", ignorenulls=True).over(so_far), F.col(f"was.{name}")), shown: F.coalesce(F.last(shown, ignorenulls=True).over(so_far), F.col(f"was.{shown}"))}
    made = made.withColumns({f"new_{c}": v for c, v in after.items()})
    made = made.withColumns({f"prior_{c}": F.when(F.row_number().over(turns) == 1, F.col(f"was.{c}")).otherwise(F.lag(f"new_{c}").over(turns)) for c in names})
    made = made.withColumn("prior_confidence", F.when(F.row_number().over(turns) == 1, F.col("was.confidence")).otherwise("verified"))
    changed = reduce(lambda a, b: a | b, [~F.col(f"new_{c}").eqNullSafe(F.col(f"prior_{c}")) for c in (name, shown)], F.coalesce(F.col("prior_confidence") != "verified", F.lit(True)))
    made = made.withColumn("_moved", F.when(changed, F.col("decided_at")))
    audit = made.select("correction_id", "package_id", "actor", "reason", F.col("decided_at").alias("observed_at"), *[f"{w}_{c}" for c in names for w in ("prior", "new")], "prior_confidence", F.lit("verified").alias("new_confidence"))
    last = made.groupBy("package_id").agg(F.max_by(F.struct(f"new_{name}", f"new_{shown}"), "_turn").alias("new"), F.max("_moved").alias("moved"))
    both = packages.join(last, "package_id", "left")
    pick = lambda c: F.when(F.col("new").isNull(), F.col(c)).otherwise(F.col(f"new.new_{c}"))
    written = {name: pick(name), shown: pick(shown), "confidence": F.when(F.col("new").isNull(), F.col("confidence")).otherwise("verified"), "resolved_at": F.greatest("resolved_at", "moved")}
    return both.select(*[written.get(c, F.col(c)).alias(c) for c in packages.columns]), audit, checked.where(F.col("refused").isNotNull()).select("correction_id", "package_id", "refused")
