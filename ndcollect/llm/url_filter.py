"""URL filtering by rules and by empirical-Bayes host reputation, in DataFrame functions only.

Labelled page outcomes (bad or not) are counted by host, registered domain and public suffix. Rates are shrunk
down the hierarchy: the suffix towards the whole, the domain towards its suffix, the host towards its domain,
each parent taken without the child's own outcomes.
The strength of each beta prior follows from the spread of its level's rates around their parents (the
method of moments for the beta-binomial), so a level whose members differ keeps their differences and a level
of alike members is pooled. A host is blocked if the lower bound of its posterior bad rate (mean less ``z``
standard deviations) is above ``limit``. Hosts that no page with an outcome has are judged by their prior: the mean is
that of their domain, else suffix, else the whole, the strength that of the host level, lessened by that of each
level without outcomes.

Outcomes are summed by host before anything meets (one row a host, however many pages), the three prior
strengths are single numbers, hosts without outcomes are made distinct before they meet their domains and
suffixes, and the pages meet the table of blocked hosts in one merge join that AQE can split.

Public suffixes are an input: ``suffixes`` takes any number of rules of the public suffix list (plain, ``*.x`` and
``!a.x``; ``suffix_rules`` reads the list's file form); the last label is a suffix where no rule fits.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged
like an unknown host; hosts that are addresses or have no dot are their own domain; outcomes of unknown pages
are ignored, a page with several outcomes is bad if any is; without outcomes everything that no rule blocks
is allowed; extra columns are ignored by ``judge``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes of more than one label that count where no list is given. Fixed values.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "co.nz", "com.br", "co.za", "com.mx", "co.in")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def suffix_rules(text: str) -> tuple[str, ...]:
    """The rules of a public suffix list: a rule a line, up to white space; lines that begin with // are remarks."""
    lines = (line.split() for line in text.splitlines() if not line.startswith("//"))
    return tuple(words[0].lower() for words in lines if words)


def domain_and_suffix(host: Column, suffixes: Iterable[str] = SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix of a host without its port. The longest rule that fits counts."""
    plain = {s for s in suffixes if s[:1] not in ("*", "!")}
    below = {s[2:] for s in suffixes if s.startswith("*.")}
    but = {s[1:] for s in suffixes if s.startswith("!")}
    name = F.regexp_replace(host, r":\d*$", "")
    labels = F.split(name, r"\.")
    n = F.size(labels)
    last = lambda k: F.concat_ws(".", F.slice(labels, -k, k))
    whole = (n < 2) | name.rlike(r"^[0-9.]+$") | name.contains("[")
    found = F.lit(1)
    for k in range(1, 2 + max((s.count(".") for s in (*plain, *("." + b for b in below))), default=0)):
        fits = last(k).isin(*plain) if plain else F.lit(False)
        if below and k > 1:
            fits = fits | last(k - 1).isin(*below) & ~(last(k).isin(*but) if but else F.lit(False))
        found = F.when((n >= k) & fits, F.lit(k)).otherwise(found)
    part = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k), ".")
    return F.when(whole, name).otherwise(part(F.least(found + 1, n))), F.when(whole, F.lit("")).otherwise(part(found))


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (action, ``host/path``) that fits, and its action; nulls if none does."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(action)
    return rule, action


def _strength(groups: DataFrame, parent: Column) -> float:
    """Prior strength of a level: rows (n, bad) and the mean of their parent."""
    m, n = parent, F.col("n")
    s = F.sum(F.pow(F.col("bad") - n * m, 2) / n)
    v = F.sum(m * (1 - m))
    w = F.sum((n - 1) * m * (1 - m))
    got = groups.where("n > 0").select(s.alias("s"), v.alias("v"), w.alias("w")).first()
    if got is None or not got.w:
        return 1.0
    within = min(max((got.s - got.v) / got.w, 1e-4), 0.5)
    return 1 / within - 1


def reputation(pages: DataFrame, outcomes: DataFrame, *, z: float = 1.645, suffixes: Iterable[str] = SUFFIXES) -> tuple[DataFrame, dict[str, DataFrame], float]:
    """Posterior lower bounds of the bad rate by host, domain and suffix, and overall.

    ``pages`` has page_id and url, ``outcomes`` page_id and bad (0 or 1).
    """
    host, _ = host_and_path(F.col("url"))
    domain, suffix = domain_and_suffix(F.col("host"), suffixes)
    named = pages.select("page_id", host.alias("host"))
    seen = outcomes.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").cast("long").alias("bad"))
    counts = named.join(seen.hint("merge"), "page_id").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    hosts = materialize(counts.withColumn("domain", domain).withColumn("suffix", suffix), "url-hosts")
    domains = materialize(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "url-domains")
    ends = materialize(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "url-suffixes")
    total = ends.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = ((total.bad or 0) + 0.5) / ((total.n or 0) + 1)

    def shrink(level: DataFrame, parent: Column) -> DataFrame:
        k = F.lit(_strength(level, parent))
        a, b = k * parent + F.col("bad"), k * (1 - parent) + F.col("n") - F.col("bad")
        mean = a / (a + b)
        low = mean - F.lit(z) * F.sqrt(mean * (1 - mean) / (a + b + 1))
        return level.select("*", k.alias("k"), parent.alias("prior"), mean.alias("mean"), low.alias("low"))

    def below(level: DataFrame, above: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
        """The level with its parents, and each parent's mean by everything but the child's own outcomes."""
        up = above.select(*keys, *(F.col(c).alias(f"up_{c}") for c in ("k", "prior", "n", "bad")))
        mean = (F.col("up_k") * F.col("up_prior") + F.col("up_bad") - F.col("bad")) / (F.col("up_k") + F.col("up_n") - F.col("n"))
        return level.join(up.hint("merge"), keys).withColumn("up", mean), F.col("up")

    keep = ("n", "bad", "k", "prior", "mean", "low")
    ends = materialize(shrink(ends, F.lit(overall)).select("suffix", *keep), "url-suffixes")
    domains = materialize(shrink(*below(domains, ends, ["suffix"])).select("suffix", "domain", *keep), "url-domains")
    hosts = materialize(shrink(*below(hosts, domains, ["suffix", "domain"])).select("host", *keep), "url-hosts")
    return hosts, {"domain": domains, "suffix": ends}, overall


def unseen(pages: DataFrame, hosts: DataFrame, levels: dict[str, DataFrame], overall: float, *, z: float = 1.645, suffixes: Iterable[str] = SUFFIXES) -> DataFrame:
    """host, mean and low of the hosts of ``pages`` (with a column host) that ``hosts`` lacks, by what ``reputation`` gave."""
    found = [level.select("k").first() for level in (hosts, levels["domain"], levels["suffix"])]
    if None in found:
        return pages.sparkSession.createDataFrame([], "host string, mean double, low double")
    of_host, of_domain, of_suffix = (r.k / (r.k + 1) for r in found)  # what is left of a unit's variance within it
    domain, suffix = domain_and_suffix(F.col("host"), suffixes)
    met = materialize(pages.select("host").distinct(), "url-met")  # else the join would be pushed below, to all pages
    new = met.join(hosts.select("host").hint("merge"), "host", "left_anti")
    new = new.withColumn("domain", domain).withColumn("suffix", suffix)
    new = new.join(levels["domain"].select("suffix", "domain", F.col("mean").alias("d")).hint("merge"), ["suffix", "domain"], "left")
    new = new.join(levels["suffix"].select("suffix", F.col("mean").alias("s")).hint("merge"), "suffix", "left")
    mean = F.coalesce("d", "s", F.lit(overall))
    within = F.lit(of_host) * F.when(F.col("d").isNotNull(), 1.0).otherwise(of_domain) * F.when(F.coalesce("d", "s").isNotNull(), 1.0).otherwise(of_suffix)
    return new.select("host", mean.alias("mean"), (mean - F.lit(z) * F.sqrt(mean * (1 - mean) * (1 - within))).alias("low"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], *, limit: float = 0.25, z: float = 1.645, suffixes: Iterable[str] = SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, and the method's own verdict ``reputation`` of every page."""
    hosts, levels, overall = reputation(pages, outcomes, z=z, suffixes=suffixes)
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, action = matched_rule(F.col("host"), F.col("path"), rules)
    known = hosts.select("host", "low").unionByName(unseen(parsed, hosts, levels, overall, z=z, suffixes=suffixes).select("host", "low"))
    bad = known.where(F.col("low") > limit).select("host", F.lit(True).alias("bad_host"))
    met = parsed.join(materialize(bad, "url-blocked").hint("merge"), "host", "left")
    own = F.when(F.col("bad_host"), F.lit("block")).otherwise(F.lit("allow"))
    return met.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, own).alias("verdict"), own.alias("reputation"))
