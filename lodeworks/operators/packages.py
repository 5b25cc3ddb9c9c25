"""Package survey: what is used, in which versions, what can move to modern .NET, and what holds projects back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Packages that only run on System.Web, and packages known to run on modern .NET.
TIED_TO_SYSTEM_WEB = (
    "Microsoft.AspNet.Mvc",
    "Microsoft.AspNet.Razor",
    "Microsoft.AspNet.WebPages",
    "Microsoft.AspNet.Web.Optimization",
    "Microsoft.AspNet.WebApi.WebHost",
    "Microsoft.AspNet.SignalR.SystemWeb",
    "Microsoft.Owin.Host.SystemWeb",
    "Microsoft.Web.Infrastructure",
    "Microsoft.CodeDom.Providers.DotNetCompilerPlatform",
    "WebGrease",
)
KNOWN_PORTABLE = (
    "Newtonsoft.Json", "NHibernate", "Remotion.Linq", "Autofac",
    "Castle.Core", "log4net", "NLog", "Serilog", "AutoMapper",
    "FluentValidation", "Dapper", "Polly", "MediatR", "NUnit",
    "xunit", "Moq", "FluentAssertions", "System.Text.Json",
    "Microsoft.Extensions.Logging", "Microsoft.Extensions.Configuration",
)


def classify(package: Column, tied: tuple[str, ...] = TIED_TO_SYSTEM_WEB, portable: tuple[str, ...] = KNOWN_PORTABLE) -> Column:
    """TiedToSystemWeb, Portable or Unknown, by id without case."""
    low = F.lower(package)
    return F.when(low.isin(*[x.lower() for x in tied]), "TiedToSystemWeb").when(low.isin(*[x.lower() for x in portable]), "Portable").otherwise("Unknown")


def catalogue(refs: DataFrame, **lists) -> DataFrame:
    """(id, versions, projects, divergent, portability) of refs (project, id, version).

    Ids and versions are one without case, written as their least spelling. projects counts references: one project
    that names a package twice counts twice. A package's versions are few, so they are gathered.
    """
    v = refs.groupBy(F.lower("id").alias("_k"), F.lower("version").alias("_v")).agg(F.min("id").alias("id"), F.min("version").alias("version"), F.count(F.lit(1)).alias("n"))
    p = v.groupBy("_k").agg(F.min("id").alias("id"), F.array_sort(F.collect_list("version")).alias("versions"), F.sum("n").alias("projects"))
    return p.select("id", "versions", "projects", (F.size("versions") > 1).alias("divergent"), classify(F.col("id"), **lists).alias("portability"))


def project_modernisation(projects: DataFrame, refs: DataFrame, **lists) -> DataFrame:
    """projects (project, sdk_style) with dead_ends, blocked and convertible_as_is.

    A project whose file can't be read counts as not SDK-style, thus as convertible; its column broken, if any, stays.
    """
    tied = refs.where(classify(F.col("id"), **lists) == "TiedToSystemWeb").groupBy("project").agg(F.array_sort(F.collect_set("id")).alias("dead_ends"))
    none = F.array().cast("array<string>")
    out = projects.join(tied, "project", "left").withColumn("dead_ends", F.coalesce("dead_ends", none))
    return out.withColumn("blocked", F.size("dead_ends") > 0).withColumn("convertible_as_is", ~F.col("sdk_style") & (F.size("dead_ends") == 0))


def redirects(configs: DataFrame, needle: str = "<bindingRedirect", column: str = "content") -> DataFrame:
    """One row, redirects: occurrences of the needle in all texts, without case."""
    low = F.lower(F.col(column))
    n = (F.length(low) - F.length(F.replace(low, F.lit(needle.lower()), F.lit("")))) / len(needle)
    return configs.agg(F.coalesce(F.sum(n.cast("long")), F.lit(0)).alias("redirects"))


def survey(modernised: DataFrame, packages: DataFrame, redirect_count: DataFrame | None = None) -> DataFrame:
    """One row of counters over projects and packages; tended: no divergent package and no redirect."""
    p = modernised.agg(
        F.count(F.lit(1)).alias("projects"), F.count_if("sdk_style").alias("sdk_style"), F.count_if(~F.col("sdk_style")).alias("pre_sdk"),
        F.count_if("blocked").alias("blocked"), F.count_if("convertible_as_is").alias("convertible_as_is"),
    )
    k = packages.agg(
        F.count(F.lit(1)).alias("packages"), F.coalesce(F.sum("projects"), F.lit(0)).alias("package_references"), F.count_if("divergent").alias("divergent"),
        F.count_if(F.col("portability") == "TiedToSystemWeb").alias("tied"), F.count_if(F.col("portability") == "Portable").alias("portable"), F.count_if(F.col("portability") == "Unknown").alias("unknown"),
    )
    out = p.crossJoin(F.broadcast(k))
    out = out.crossJoin(F.broadcast(redirect_count)) if redirect_count is not None else out.withColumn("redirects", F.lit(0).cast("long"))
    return out.withColumn("tended", (F.col("divergent") == 0) & (F.col("redirects") == 0))


def dead_ends(packages: DataFrame, top: int = 10) -> DataFrame:
    return packages.where("portability = 'TiedToSystemWeb'").orderBy(F.desc("projects"), "id").limit(top)


def unknown(packages: DataFrame, top: int = 15) -> DataFrame:
    return packages.where("portability = 'Unknown'").orderBy(F.desc("projects"), "id").limit(top)
