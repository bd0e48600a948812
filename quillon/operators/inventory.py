"""Inventories of known values, from tables of configuration texts, merged and capped.

Host probing is left to the user: these operators take rows (source, path, text) and return rows
(id, literal, case_sensitive, token, source).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PUBLIC_HOSTS = ("github.com", "gitlab.com", "bitbucket.org", "codeberg.org", "localhost", "registry.npmjs.org", "pypi.org", "docker.io", "ghcr.io", "quay.io", "index.docker.io")


def _found(files: DataFrame, kind: str, pattern: str, group: int = 1) -> DataFrame:
    values = F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    return files.select("source", F.lit(kind).alias("kind"), F.explode(values).alias("literal")).where(F.length("literal") > 0)


def git_identities(files: DataFrame) -> DataFrame:
    return _found(files, "name", r"(?m)^\s*name\s*=\s*(.+?)\s*$").union(_found(files, "email", r"(?m)^\s*email\s*=\s*(\S+)"))


def included_files(files: DataFrame) -> DataFrame:
    """Paths of configuration files that a git configuration includes."""
    return files.select("source", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^\s*path\s*=\s*(\S+)"), F.lit(1))).alias("path"))


def ssh_hosts(files: DataFrame) -> DataFrame:
    """Hosts, host names and users of an SSH configuration; patterns are left out."""
    hosts = _found(files, "host", r"(?mi)^\s*Host\s+(.+?)\s*$").select("source", "kind", F.explode(F.split("literal", r"\s+")).alias("literal")).where(~F.col("literal").rlike("[*?!]"))
    return hosts.union(_found(files, "host", r"(?mi)^\s*HostName\s+(\S+)")).union(_found(files, "user", r"(?mi)^\s*User\s+(\S+)"))


def network_hosts(files: DataFrame) -> DataFrame:
    """Search domains and names of a resolver's and a hosts file."""
    search = _found(files, "host", r"(?m)^\s*(?:search|domain)\s+(.+?)\s*$")
    lines = _found(files, "host", r"(?m)^\s*[0-9a-fA-F.:]+\s+([^#\n]+)")
    return search.union(lines).select("source", "kind", F.explode(F.split(F.trim("literal"), r"\s+")).alias("literal")).where(~F.col("literal").rlike(r"^(?:localhost.*|ip6-.*|broadcasthost)$"))


def tool_hosts(files: DataFrame) -> DataFrame:
    """Hosts of registries, clusters and netrc machines, and account numbers."""
    hosts = _found(files, "host", r"(?m)^\s*(?:@\w+:)?(?:registry|server|index-url|extra-index-url)\s*[:=]\s*[\"']?https?://(?:[^@/\s]*@)?([^/\s:\"']+)")
    return hosts.union(_found(files, "host", r"(?m)^\s*machine\s+(\S+)")).union(_found(files, "account", r"(?m)arn:aws[\w-]*:iam::([0-9]{12}):"))


def network_names(files: DataFrame) -> DataFrame:
    return _found(files, "ssid", r"(?m)^\s*(?:ssid|SSID)\s*=\s*\"?([^\"\n]+)")


def infrastructure(hosts: DataFrame, per_source: int | None = 100) -> DataFrame:
    """Hosts without public ones, with their short names, at most so many of a source; None for all."""
    own = hosts.where(~F.lower("literal").isin(*PUBLIC_HOSTS)).select("source", "kind", F.lower("literal").alias("literal")).distinct()
    short = own.where(F.contains("literal", F.lit(".")) & ~F.col("literal").rlike("^[0-9.]+$")).select("source", "kind", F.substring_index("literal", ".", 1).alias("literal"))
    found = own.union(short.where(F.length("literal") >= 4)).distinct()
    if per_source is None:
        return found
    nth = F.row_number().over(Window.partitionBy("source").orderBy("literal"))
    return found.withColumn("nth", nth).where(F.col("nth") <= per_source).drop("nth")


def merged(old: DataFrame, new: DataFrame, most: int = 1000) -> DataFrame:
    """Union by literal (lower-cased unless its case matters); old rows win, clashing ids are numbered anew."""
    both = old.withColumn("age", F.lit(0)).unionByName(new.withColumn("age", F.lit(1)))
    key = F.when(F.col("case_sensitive"), F.col("literal")).otherwise(F.lower("literal"))
    first = both.withColumn("key", key).withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("age", "id", "literal"))).where("nth = 1")
    again = F.row_number().over(Window.partitionBy("id").orderBy("age", "key"))
    numbered = first.withColumn("again", again).withColumn("id", F.when(F.col("again") > 1, F.concat_ws("-", "id", F.col("again").cast("string"))).otherwise(F.col("id")))
    return numbered.orderBy("age", "id").limit(most).drop("age", "key", "nth", "again")


def known_values(inventory: DataFrame, least: int = 4) -> DataFrame:
    return inventory.where(F.length("literal") >= least).select("literal").distinct()


def minted(pairs: DataFrame, taken: DataFrame) -> DataFrame:
    """kind, value, stand_in -> the same without collisions: stand-ins that two values share, or that the texts
    hold already (taken: word), get the number of their value's place."""
    nth = F.row_number().over(Window.partitionBy("stand_in").orderBy("value"))
    known = taken.select(F.col("word").alias("stand_in"), F.lit(True).alias("is_taken")).distinct()
    marked = pairs.withColumn("nth", nth).join(known, "stand_in", "left")
    fresh = F.when((F.col("nth") > 1) | F.col("is_taken").isNotNull(), F.concat("stand_in", F.col("nth").cast("string"))).otherwise(F.col("stand_in"))
    return marked.select(*[c for c in pairs.columns if c != "stand_in"], fresh.alias("stand_in"))


def spelled(value: Column) -> Column:
    """array of a value's spellings: hexadecimal, percent, octal and Unicode escapes of its bytes."""
    h = F.lower(F.hex(F.encode(value, "utf-8")))
    pairs = F.regexp_extract_all(h, F.lit(".."), F.lit(0))
    units = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.lpad(F.lower(F.hex(F.ascii(c).cast("long"))), 4, "0"))
    octal = F.transform(pairs, lambda p: F.lpad(F.conv(p, 16, 8), 3, "0"))
    return F.array(
        F.concat(F.lit("\\x"), F.array_join(pairs, "\\x")), F.concat(F.lit("%"), F.upper(F.array_join(pairs, "%"))), F.concat(F.lit("\\"), F.array_join(octal, "\\")), F.concat(F.lit("\\u"), F.array_join(units, "\\u")),
        F.array_join(F.transform(pairs, lambda p: F.concat(F.lit("0x"), p)), ", "),
    )


def os_identity(hosts: DataFrame) -> DataFrame:
    """hosts: source, user, host, home (a row per machine) -> source, kind, literal. System accounts and names that
    every machine has are left out."""
    common = ("root", "admin", "user", "ubuntu", "debian", "runner", "localhost", "localhost.localdomain")
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("literal")) for k in ("user", "host", "home")]))
    found = hosts.select("source", kinds.alias("x")).select("source", "x.kind", "x.literal")
    return found.where(F.length("literal") >= 3).where(~F.lower("literal").isin(*common) & ~F.col("literal").isin("/root", "/home/user")).distinct()


def repository_remotes(files: DataFrame, most: int = 100) -> DataFrame:
    """files: source (a repository), path, text of git configurations -> kind, literal: hosts and owners of remotes on
    hosts of one's own, each once, `most` of a repository."""
    from quillon.sources.wire import remote_host, remote_owner, remote_urls

    urls = files.where(F.col("path").rlike(r"(?:^|/)\.git/config$")).select("source", F.explode(remote_urls(F.col("text"))).alias("url"))
    nth = F.row_number().over(Window.partitionBy("source").orderBy("url"))
    kept = urls.distinct().withColumn("nth", nth).where(F.col("nth") <= most)
    host = F.lower(remote_host(F.col("url")))
    hosts = kept.select(F.lit("host").alias("kind"), host.alias("literal")).where(~F.col("literal").isin(*PUBLIC_HOSTS))
    owners = kept.select(F.lit("owner").alias("kind"), remote_owner(F.col("url")).alias("literal"))
    return hosts.union(owners).where(F.length("literal") >= 3).distinct()


def tailnet_names(status: DataFrame, text: str = "text") -> DataFrame:
    """source, kind, literal: machine and network names of a tailnet's JSON status, own machine and peers."""
    peer = "struct<HostName:string,DNSName:string>"
    read = F.from_json(text, f"struct<Self:{peer},Peer:map<string,{peer}>,MagicDNSSuffix:string>")
    rows = status.select("source", read.alias("s"))
    machines = rows.select("source", F.explode(F.concat(F.array("s.Self"), F.coalesce(F.map_values("s.Peer"), F.array().cast(f"array<{peer}>")))).alias("p"))
    hosts = machines.select("source", F.explode(F.array("p.HostName", F.regexp_replace("p.DNSName", r"\.$", ""))).alias("literal")).select("source", F.lit("host").alias("kind"), F.lower("literal").alias("literal"))
    nets = rows.select("source", F.lit("host").alias("kind"), F.lower("s.MagicDNSSuffix").alias("literal"))
    return hosts.union(nets).where((F.length("literal") >= 3) & (F.col("literal") != "localhost")).distinct()
