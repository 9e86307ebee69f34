"""Policies: robots rules, blocked networks, redirects, domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import url as U
from ..functions.text import let
from ..plans.storage import keep

AGENT = "gleanery"
MAX_REDIRECTS = 5

# IPv4 networks that must not be fetched.
BLOCKED_IPV4 = [
    ("127.0.0.0", 8), ("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16), ("169.254.0.0", 16), ("100.64.0.0", 10),
    ("192.0.2.0", 24), ("198.51.100.0", 24), ("203.0.113.0", 24), ("0.0.0.0", 8), ("240.0.0.0", 4), ("255.255.255.255", 32),
]

# IPv6 networks that must not be fetched.
BLOCKED_IPV6 = [("::1", 128), ("::", 128), ("fc00::", 7), ("fe80::", 10), ("ff00::", 8), ("2001:db8::", 32), ("100::", 64)]

# Addresses of metadata services.
METADATA_IPS = ["169.254.169.254", "fd00:ec2::254", "169.254.170.2"]


# --- robots -----------------------------------------------------------------------------------


def robots_lines(files: DataFrame) -> DataFrame:
    """origin, line_no, key, value of each directive, with blank lines as key ''; comments are dropped."""
    lines = files.select("origin", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("line_no", "raw"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace(F.regexp_replace("raw", "#.*$", ""), r"\s+$|^\s+", "")))
    lines = lines.where((F.col("line") == "") | F.contains("line", F.lit(":")))
    key = F.lower(F.trim(F.substring_index("line", ":", 1)))
    value = F.trim(F.expr("substring(line, instr(line, ':') + 1)"))
    return lines.select("origin", "line_no", F.when(F.col("line") == "", "").otherwise(key).alias("key"), F.when(F.col("line") != "", value).alias("value"))


def robots_groups(files: DataFrame) -> DataFrame:
    """origin, group_no, agents, rules array<struct<pattern, allow>>, crawl_delay.

    A group ends at a blank line, and at a user-agent line behind rules; consecutive agent lines share a group; rules in front
    of any agent go to the next group. A fold over each file's lines: one row per file, so nothing is exchanged.
    """
    group = "struct<agents:array<string>,rules:array<struct<pattern:string,allow:boolean>>,delay:double>"
    state = f"struct<done:array<{group}>,agents:array<string>,rules:array<struct<pattern:string,allow:boolean>>,delay:double,open:boolean>"
    start = F.struct(F.array(), F.array(), F.array(), F.lit(None), F.lit(False)).cast(state)
    clean = F.transform(F.split(F.coalesce("text", F.lit("")), r"\r?\n"), lambda x: F.regexp_replace(F.regexp_replace(x, "#.*$", ""), r"\s+$|^\s+", ""))
    lines = F.filter(clean, lambda x: (x == "") | F.contains(x, F.lit(":")))

    def flush(s: Column) -> Column:
        own = F.struct(s["agents"].alias("agents"), s["rules"].alias("rules"), s["delay"].alias("delay"))
        return F.when(F.size(s["agents"]) > 0, F.concat(s["done"], F.array(own.cast(group)))).otherwise(s["done"])

    def fresh(s: Column) -> Column:
        return F.struct(flush(s), F.array(), F.array(), F.lit(None), F.lit(False)).cast(state)

    def step(s: Column, x: Column) -> Column:
        key = F.lower(F.trim(F.substring_index(x, ":", 1)))
        value = F.regexp_replace(x, r"^[^:]*:\s*", "")
        named = F.when(s["open"] & (F.size(s["rules"]) > 0), fresh(s)).otherwise(s)
        rule = F.array(F.struct(value.alias("pattern"), (key == "allow").alias("allow")))
        delay = F.regexp_extract(value, r"^([+-]?(\d+\.?\d*|\.\d+))", 1).try_cast("double")
        return (
            F.when((x == "") & s["open"], fresh(s))
            .when(x == "", s)
            .when(key == "user-agent", named.withField("agents", F.concat(named["agents"], F.array(F.lower(value)))).withField("open", F.lit(True)))
            .when(key.isin("allow", "disallow"), s.withField("rules", F.concat(s["rules"], rule)))
            .when(key == "crawl-delay", s.withField("delay", F.coalesce(delay, s["delay"])))
            .otherwise(s)
        )

    rows = files.select("origin", F.posexplode(F.aggregate(lines, start, step, flush)).alias("group_no", "g"))
    return rows.select("origin", "group_no", "g.agents", "g.rules", F.col("g.delay").alias("crawl_delay"))


def robots_sitemaps(files: DataFrame) -> DataFrame:
    return robots_lines(files).where("key = 'sitemap' AND value <> ''").select("origin", "line_no", F.col("value").alias("url"))


def matched_groups(groups: DataFrame, agent: str = AGENT) -> DataFrame:
    """Each origin's first group that names the agent, else its first for '*'."""
    exact = F.array_contains("agents", agent.lower())
    fits = groups.withColumn("__exact", exact).where(exact | F.array_contains("agents", "*"))
    order = F.row_number().over(W.partitionBy("origin").orderBy(F.col("__exact").desc(), "group_no"))
    return fits.withColumn("__r", order).where("__r = 1").drop("__r", "__exact")


def pattern_regex(pattern: Column) -> Column:
    """A robots pattern as a regular expression: * matches anything, a final $ ends the path."""
    end = F.endswith(pattern, F.lit("$"))
    body = F.when(end, F.left(pattern, F.length(pattern) - 1)).otherwise(pattern)
    quoted = F.regexp_replace(F.regexp_replace(body, r"([.+?^{}()|\[\]\\$])", r"\\$1"), r"\*", ".*")
    return F.concat(F.lit("^"), quoted, F.when(end, "$").otherwise(""))


def robots_allowed(urls: DataFrame, files: DataFrame, agent: str = AGENT) -> DataFrame:
    """url, allowed for each row of `urls`; `files` has (origin, status, text).

    The longest matching pattern decides, allow winning ties; no match, no group, no file and 4xx allow; 5xx forbids. Rules stay
    an array of their origin's row, so one equi-join on the origin does it.
    """
    rules = matched_groups(robots_groups(files), agent).select("origin", "rules")
    table = files.select("origin", "status").join(rules, "origin", "left").select(F.col("origin").alias("__origin"), "status", "rules")
    rows = urls.withColumn("__o", U.origin(F.col("url"))).join(table, F.col("__o") == F.col("__origin"), "left")
    asked = F.concat(U.path(F.col("url")), F.when(U.query(F.col("url")) != "", F.concat(F.lit("?"), U.query(F.col("url")))).otherwise(""))
    fits = F.filter(F.coalesce("rules", F.array().cast("array<struct<pattern:string,allow:boolean>>")), lambda r: F.regexp_like(asked, pattern_regex(r["pattern"])))
    best = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["pattern"]).alias("n"), (r["allow"] | (r["pattern"] == "")).alias("allow"))))
    allowed = F.when(F.col("status") >= 500, False).when(F.col("status").between(200, 299), F.coalesce(best["allow"], F.lit(True))).otherwise(True)
    return rows.select(*[F.col(c) for c in urls.columns], allowed.alias("allowed"))


def crawl_delay(files: DataFrame, agent: str = AGENT, low: float = 0.5, high: float = 60.0) -> DataFrame:
    """origin, crawl_delay: the matched group's, where it is within bounds."""
    return matched_groups(robots_groups(files), agent).where(F.col("crawl_delay").between(low, high)).select("origin", "crawl_delay")


# --- networks ---------------------------------------------------------------------------------


def ipv4_number(ip: Column) -> Column:
    """A dotted address as a number, else null."""
    byte = r"(25[0-5]|2[0-4]\d|1?\d?\d|0\d\d)"
    valid = F.regexp_like(ip, F.lit(rf"^{byte}(\.{byte}){{3}}$"))
    return F.when(valid, F.aggregate(F.split(ip, r"\."), F.lit(0).cast("bigint"), lambda s, p: s * 256 + p.cast("bigint")))


def _ipv4(ip: str) -> int:
    total = 0
    for part in ip.split("."):
        total = total * 256 + int(part)
    return total


def blocked_ipv4(ip: Column) -> Column:
    def hit(n: Column) -> Column:
        found = F.lit(False)
        for net, bits in BLOCKED_IPV4:
            low = _ipv4(net)
            found = found | n.between(low, low + (1 << (32 - bits)) - 1)
        return found

    return F.coalesce(let(ipv4_number(ip), hit), F.lit(False))


def ipv6_hex(ip: Column) -> Column:
    """The address as 32 hexadecimal digits, :: filled in and a dotted tail converted; null if it isn't one."""
    groups = lambda s: F.filter(F.split(s, ":"), lambda g: g != "")
    none = F.array().cast("array<string>")

    def undotted(bare: Column) -> Column:
        def swapped(tail: Column) -> Column:
            head = F.regexp_replace(bare, r"\d+\.\d+\.\d+\.\d+$", "")
            return F.when(tail.isNotNull(), F.concat(head, F.lower(F.hex(F.floor(tail / 65536).cast("bigint"))), F.lit(":"), F.lower(F.hex(tail % 65536)))).otherwise(bare)

        return let(ipv4_number(F.regexp_extract(bare, r":(\d+\.\d+\.\d+\.\d+)$", 1)), swapped)

    def sides(plain: Column) -> Column:
        return F.struct(groups(F.substring_index(plain, "::", 1)).alias("left"), F.when(F.contains(plain, F.lit("::")), groups(F.substring_index(plain, "::", -1))).otherwise(none).alias("right"))

    def full(x: Column) -> Column:
        gap = F.greatest(F.lit(0), F.lit(8) - F.size(x["left"]) - F.size(x["right"]))
        return F.concat(x["left"], F.array_repeat(F.lit("0"), gap), x["right"])

    shown = lambda all_: F.when(F.size(all_) == 8, F.array_join(F.transform(all_, lambda g: F.lpad(g, 4, "0")), ""))
    bare = F.lower(F.regexp_replace(ip, r"^\[|\]$", ""))
    made = let(bare, lambda x: let(undotted(x), lambda plain: let(sides(plain), lambda s: let(full(s), shown))))
    return F.when(F.contains(ip, F.lit(":")), made)


def _ipv6(ip: str) -> str:
    import ipaddress

    return ipaddress.IPv6Address(ip).exploded.replace(":", "")


def blocked_ipv6(ip: Column) -> Column:
    """Blocked networks, and blocked IPv4 addresses mapped into IPv6 in either notation."""

    def hit(digits: Column) -> Column:
        found = F.lit(False)
        for net, bits in BLOCKED_IPV6:
            whole, part = divmod(bits, 4)
            prefix = _ipv6(net)
            fits = F.startswith(digits, F.lit(prefix[:whole]))
            if part:
                mask = 16 - (1 << (4 - part))
                first = int(prefix[whole], 16) & mask
                fits &= F.substring(digits, whole + 1, 1).isin([f"{x:x}" for x in range(16) if x & mask == first])
            found = found | fits
        mapped = F.when(F.startswith(digits, F.lit("0" * 20 + "ffff")), F.array_join(F.transform(F.array(*[F.lit(i) for i in (25, 27, 29, 31)]), lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10)), "."))
        return F.coalesce(found, F.lit(False)) | blocked_ipv4(mapped)

    return F.coalesce(let(ipv6_hex(ip), hit), F.lit(False))


def blocked_ip(ip: Column) -> Column:
    return let(ip, lambda x: x.isin(METADATA_IPS) | F.when(F.contains(x, F.lit(":")), blocked_ipv6(x)).otherwise(blocked_ipv4(x)))


def private_host(host: Column) -> Column:
    """Whether a host is localhost or a literal address that must not be fetched."""
    return let(F.regexp_replace(host, r"^\[|\]$", ""), lambda h: (h == "localhost") | F.endswith(h, F.lit(".localhost")) | F.coalesce(blocked_ip(h), F.lit(False)))


def ssrf(urls: DataFrame, dns: DataFrame | None = None) -> DataFrame:
    """`urls` with ssrf_blocked: a literal or any resolved address is blocked, or the host is localhost. Unresolved hosts pass."""
    blocked = F.coalesce(private_host(U.host(F.col("url"))), F.lit(False))
    if dns is None:
        return urls.withColumn("ssrf_blocked", blocked)
    bad = dns.groupBy(F.lower("host").alias("__host")).agg(F.bool_or(blocked_ip(F.col("address"))).alias("__bad"))
    rows = urls.withColumn("__h", F.regexp_replace(U.host(F.col("url")), r"^\[|\]$", "")).join(bad, F.col("__h") == F.col("__host"), "left")
    return rows.select(*[F.col(c) for c in urls.columns], (blocked | F.coalesce("__bad", F.lit(False))).alias("ssrf_blocked"))


# --- redirects and domains --------------------------------------------------------------------


def redirect_chain(starts: DataFrame, redirects: DataFrame, limit: int = MAX_REDIRECTS) -> DataFrame:
    """url, final_url, hops, error for each start; `redirects` has (from_url, to_url).

    LOOP if a URL repeats, TOO_MANY_REDIRECTS beyond `limit` hops, UNSAFE_SCHEME for a target that isn't http(s), SSRF_BLOCKED
    for a private literal address. A redirect is resolved and judged once, whoever follows it; then `limit` + 1 equi-joins: the
    depth is bounded, so no recursion is needed.
    """
    edges = redirects.where("to_url IS NOT NULL").select("from_url", U.resolve(F.col("to_url"), F.col("from_url")).alias("__target"))
    private = blocked_ip(F.regexp_replace(U.host(F.col("__target")), r"^\[|\]$", ""))
    edges = keep(edges.withColumn("__bad", F.when(F.col("__target").isNull(), "UNSAFE_SCHEME").when(private, "SSRF_BLOCKED")))
    rows = starts.select("url", F.col("url").alias("final_url"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("error"), F.array("url").alias("__seen"))
    known = F.col("from_url").isNotNull()
    for _ in range(limit + 1):
        rows = rows.join(edges, (F.col("final_url") == F.col("from_url")) & F.col("error").isNull(), "left")
        loop = F.when(F.array_contains("__seen", F.col("__target")), "LOOP")
        error = F.when(~known, F.col("error")).when(F.col("hops") >= limit, "TOO_MANY_REDIRECTS").otherwise(F.coalesce(loop, F.col("__bad")))
        target = F.col("__target")
        moved = known & error.isNull()
        seen = F.when(moved, F.concat("__seen", F.array(target))).otherwise(F.col("__seen"))
        rows = rows.select("url", F.when(moved, target).otherwise(F.col("final_url")).alias("final_url"), (F.col("hops") + moved.cast("int")).alias("hops"), error.alias("error"), seen.alias("__seen"))
    return rows.drop("__seen")


def domain_verdicts(hosts: DataFrame, allow: DataFrame | None = None, deny: DataFrame | None = None) -> DataFrame:
    """host, permitted of each distinct host: it, or a domain it is in, is allowed (if `allow` is given) and none is denied; tables have (domain)."""
    parts = F.split("host", r"\.")
    names = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    rows = hosts.select("host").distinct().select("host", F.explode(names).alias("domain"))
    for name, table in (("__allow", allow), ("__deny", deny)):
        known = table.select("domain").distinct().withColumn(name, F.lit(True)) if table is not None else None
        rows = rows.join(known, "domain", "left") if known is not None else rows.withColumn(name, F.lit(None).cast("boolean"))
    hit = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return rows.groupBy("host").agg((F.lit(allow is None) | hit("__allow")).alias("__a"), hit("__deny").alias("__d")).select("host", (F.col("__a") & ~F.col("__d")).alias("permitted"))


def domain_permitted(urls: DataFrame, allow: DataFrame | None = None, deny: DataFrame | None = None) -> DataFrame:
    """`urls` with permitted, judged once per host; a URL without host is permitted where nothing must be allowed."""
    rows = urls.withColumn("__h", F.coalesce(U.host(F.col("url")), F.lit("")))
    verdicts = domain_verdicts(rows.select(F.col("__h").alias("host")), allow, deny)
    return rows.join(verdicts, F.col("__h") == F.col("host"), "left").select(*[rows[c] for c in urls.columns], F.coalesce("permitted", F.lit(allow is None)).alias("permitted"))


def domain_policy(urls: DataFrame, allow: DataFrame | None = None, deny: DataFrame | None = None) -> DataFrame:
    """The rows of `urls` that domain_permitted permits."""
    return domain_permitted(urls, allow, deny).where("permitted").drop("permitted")


def visitable(urls: DataFrame, robots: DataFrame | None = None, dns: DataFrame | None = None, allow: DataFrame | None = None, deny: DataFrame | None = None) -> DataFrame:
    """`urls` with error, the first of a URL's own error, SSRF_BLOCKED, DOMAIN_DENIED and ROBOTS_DISALLOWED; null for one that may be fetched.

    Tables that aren't given forbid nothing.
    """
    rows = ssrf(urls, dns)
    rows = domain_permitted(rows, allow, deny) if allow is not None or deny is not None else rows.withColumn("permitted", F.lit(True))
    rows = robots_allowed(rows, robots) if robots is not None else rows.withColumn("allowed", F.lit(True))
    error = F.coalesce(U.url_error(F.col("url")), F.when(F.col("ssrf_blocked"), "SSRF_BLOCKED"), F.when(~F.col("permitted"), "DOMAIN_DENIED"), F.when(~F.col("allowed"), "ROBOTS_DISALLOWED"))
    return rows.withColumn("error", error).drop("ssrf_blocked", "permitted", "allowed")


def host_gaps(log: DataFrame, gap_ms: int = 500) -> DataFrame:
    """Requests with the milliseconds since the host's last one, and whether that is less than the gap."""
    before = F.lag("ts").over(W.partitionBy("host").orderBy("ts", "request_id"))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    gap = ((micros(F.col("ts")) - micros(before)) / 1000).cast("bigint")
    return log.withColumn("gap_ms", gap).withColumn("too_soon", F.coalesce(gap < gap_ms, F.lit(False)))


def schedule(log: DataFrame, delays: DataFrame | None = None, gap_ms: int = 500) -> DataFrame:
    """`log` (request_id, host, ts) with start_ms, the earliest time (epoch ms) that keeps every gap of the host, and wait_ms.

    `delays` has (host, crawl_delay) in seconds; the larger of that and the gap counts. A request's start is the largest of
    ts[j] + (i - j) * gap over the earlier ones j, so a running maximum of ts[j] - j * gap gives it without a loop.
    """
    rows = log if delays is None else log.join(delays.select("host", F.col("crawl_delay").alias("__delay")), "host", "left")
    gap = F.greatest(F.lit(gap_ms), F.coalesce((F.col("__delay") * 1000).cast("bigint"), F.lit(0))) if delays is not None else F.lit(gap_ms)
    own = W.partitionBy("host").orderBy("ts", "request_id")
    rows = rows.withColumn("__gap", gap.cast("bigint")).withColumn("__at", F.unix_millis(F.col("ts").cast("timestamp"))).withColumn("__n", F.row_number().over(own).cast("bigint"))
    start = F.max(F.col("__at") - F.col("__n") * F.col("__gap")).over(own.rowsBetween(W.unboundedPreceding, 0)) + F.col("__n") * F.col("__gap")
    return rows.withColumn("start_ms", start).withColumn("wait_ms", F.col("start_ms") - F.col("__at")).select(*log.columns, "start_ms", "wait_ms")
