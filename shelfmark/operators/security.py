"""Security datasets by weighted evidence: a folder counts when observations about it add up.

Every observation is a condition over counts of one aggregation, of files of
the subtree by ending and of names in the folder or right below it; table
headers come as rows of their own. A folder qualifies with a score of LEAST_SCORE
from two observations, or from one as strong as that.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.units import ancestors
from shelfmark.operators.recognise import CONTAINERS, SPLIT_FOLDERS, extension_of, name_of

#: Thresholds, endings, names and words that count as evidence.
LEAST_SCORE, LEAST_SIGNALS, LEAST_DIGESTS, LEAST_DIGEST_SHARE = 4.0, 2, 20, 0.4
CAPTURES = ("pcap", "pcapng", "cap", "erf", "snoop")
FLOWS = ("binetflow", "netflow", "flow", "argus", "ipfix", "nfcapd", "sflow")
EVENT_LOGS = ("evtx", "etl")
SAMPLES = ("exe", "dll", "apk", "elf", "vir", "sys")
ZEEK = (
    "conn.log", "dns.log", "http.log", "ssl.log", "x509.log", "files.log", "weird.log", "notice.log", "smtp.log", "ssh.log", "ftp.log", "dhcp.log", "ntp.log", "smb_files.log", "smb_mapping.log", "kerberos.log", "rdp.log",
    "software.log", "tunnel.log", "capture_loss.log", "stats.log", "known_hosts.log", "known_services.log", "signatures.log", "intel.log", "traceroute.log",
)
SURICATA = ("eve.json", "suricata.yaml")
SNORT = ("alert.fast", "alert.full", "snort.conf", "unified2")
HOST_LOGS = (
    "security.evtx", "system.evtx", "application.evtx", "microsoft-windows-sysmon%4operational.evtx", "microsoft-windows-powershell%4operational.evtx", "windows powershell.evtx", "sysmon.evtx", "sysmonconfig.xml",
    "auth.log", "authpriv.log", "secure.log", "audit.log", "sudo.log", "wtmp", "btmp", "utmp", "lastlog",
)
INTEL = ("ioc", "iocs", "indicator", "indicators", "misp", "stix", "taxii", "openioc", "yara", "threatfox", "alienvault", "otx", "malwarebazaar", "urlhaus", "cti")
MALWARE_FOLDERS = (
    "malware", "malwares", "malicious", "malware_samples", "malwaresamples", "trojan", "trojans", "ransomware", "backdoor", "spyware", "worm", "adware", "rootkit", "botnet", "virusshare", "virussign", "malwarebazaar", "thezoo",
    "malimg", "malmem", "vxheaven", "vx-underground",
)
CLASS_PAIRS = (("benign", "malicious"), ("benign", "malware"), ("goodware", "malware"), ("clean", "infected"))
HASH_LISTS = ("sha256sums.txt", "md5sums.txt", "hashes.txt", "sha256.txt")
CTF = ("ctf", "capture-the-flag", "picoctf", "hackthebox", "tryhackme", "htb-", "writeup", "writeups", "pwnable", "reversing", "forensics-challenge")
CHALLENGES = ("flag.txt", "flag", "flag.png", "solve.py", "exploit.py")
DIGEST_NAME = r"^[0-9a-f]{32}(?:[0-9a-f]{32})?(?:\.[a-z0-9]{1,8})?$"

#: Columns of intrusion tables by family, three of which tell it; bytes of a header and tables a folder that are looked at.
TABLE_FAMILIES = (
    ("UNSW-NB15", ("attack_cat", "sttl", "dttl", "sload", "dload", "ct_srv_src")),
    ("CIC flow", ("flow duration", "fwd packet length max", "bwd packet length max", "flow bytes/s", "flow iat mean", "total fwd packets")),
    ("KDD", ("protocol_type", "src_bytes", "dst_bytes", "num_failed_logins", "srv_serror_rate", "dst_host_srv_count")),
    ("CTU/Argus", ("srcaddr", "dstaddr", "sport", "dport", "totbytes", "srcbytes")),
    ("Zeek/TSV", ("ts", "uid", "id.orig_h", "id.resp_h", "id.orig_p", "id.resp_p")),
    ("generic flow", ("src_ip", "dst_ip", "src_port", "dst_port", "protocol", "label")),
    ("generic flow", ("srcip", "dstip", "sport", "dsport", "proto", "attack")),
)
HEADER_BYTES, HEADERS, TABLE_BYTES = 8192, 3, 4096

#: Known datasets as they are spelled without punctuation, their names and formats.
KNOWN = (
    ("unswnb15", "UNSW-NB15", "intrusion_detection"), ("unswnb", "UNSW-NB15", "intrusion_detection"), ("cicids2017", "CICIDS2017", "intrusion_detection"), ("csecicids2018", "CSE-CIC-IDS2018", "intrusion_detection"),
    ("cicids2018", "CSE-CIC-IDS2018", "intrusion_detection"), ("cicddos2019", "CIC-DDoS2019", "intrusion_detection"), ("ciciot2023", "CIC-IoT2023", "intrusion_detection"), ("cicandmal", "CIC-AndMal", "malware"),
    ("nslkdd", "NSL-KDD", "intrusion_detection"), ("kddcup99", "KDD Cup 99", "intrusion_detection"), ("kddcup", "KDD Cup 99", "intrusion_detection"), ("kdd99", "KDD Cup 99", "intrusion_detection"),
    ("ctu13", "CTU-13", "network_flow"), ("ctumalware", "CTU Malware Capture", "network_capture"), ("darpa", "DARPA", "intrusion_detection"), ("mawi", "MAWI", "network_capture"), ("caida", "CAIDA", "network_capture"),
    ("toniot", "TON_IoT", "intrusion_detection"), ("tonio", "TON_IoT", "intrusion_detection"), ("botiot", "Bot-IoT", "intrusion_detection"), ("iot23", "IoT-23", "network_flow"), ("ustctfc", "USTC-TFC2016", "network_capture"),
    ("iscx", "ISCX", "intrusion_detection"), ("malmem", "CIC-MalMem2022", "malware"), ("ember", "EMBER", "malware"), ("virusshare", "VirusShare", "malware"), ("virustotal", "VirusTotal", "malware"), ("malimg", "Malimg", "malware"),
    ("bodmas", "BODMAS", "malware"), ("sorel20m", "SOREL-20M", "malware"), ("drebin", "Drebin", "malware"), ("thezoo", "theZoo", "malware"), ("adfald", "ADFA-LD", "host_log"), ("adfa", "ADFA", "host_log"), ("ottrf", "OpTC", "host_log"),
    ("dapt2020", "DAPT-2020", "intrusion_detection"), ("lanl", "LANL Auth", "host_log"), ("mordor", "Mordor/Security Datasets", "host_log"), ("evtxattacksamples", "EVTX-ATTACK-SAMPLES", "host_log"),
    ("attackdatasets", "Security Datasets", "host_log"), ("unibs", "UNIBS", "network_capture"), ("isot", "ISOT", "network_flow"), ("hikari", "HIKARI-2021", "intrusion_detection"), ("edgeiiot", "Edge-IIoTset", "intrusion_detection"),
    ("wustl", "WUSTL-IIoT", "intrusion_detection"), ("swat", "SWaT", "intrusion_detection"), ("gaspipeline", "Gas Pipeline (MSU)", "intrusion_detection"), ("phishtank", "PhishTank", "threat_intel"), ("phiusiil", "PhiUSIIL", "threat_intel"),
)


def known_dataset(name: Column) -> Column:
    """(label, format) of the first known dataset that a name holds, else null: long spellings anywhere, short ones as a word, digits aside."""
    squashed, lower = F.regexp_replace(F.lower(name), "[^a-z0-9]+", ""), F.lower(name)
    tests = [squashed.contains(s) if len(s) >= 6 else lower.rlike(f"(^|[^a-z0-9]){s}[0-9]*($|[^a-z0-9])") for s, _, _ in KNOWN]
    return F.coalesce(*[F.when(test, F.struct(F.lit(label).alias("label"), F.lit(of).alias("format"))) for test, (_, label, of) in zip(tests, KNOWN, strict=True)])


def table_families(files: DataFrame) -> DataFrame:
    """(dir, family, n_tables): folders of files(path, size_bytes) with a table, in them or right below, whose header has columns of an intrusion table.

    The headers of a folder's HEADERS largest tables are read, ties by path.
    """

    def run(batches):
        for batch in batches:
            found = []
            for path in batch["path"]:
                try:
                    with open(path, "rb") as f:
                        line = f.read(HEADER_BYTES).split(b"\n", 1)[0].decode("utf-8", "replace").lower()
                except OSError:
                    line = ""
                columns = {x.strip().strip("\"'") for x in re.split(r"[,;\t|]", line)}
                found.append(next((family for family, of in TABLE_FAMILIES if len(columns.intersection(of)) >= 3), None))
            yield pd.DataFrame({"path": batch["path"], "family": pd.Series(found, dtype=object)})

    tables = files.where(extension_of(F.col("path")).isin("csv", "tsv", "txt") & (F.col("size_bytes") > TABLE_BYTES))
    near = tables.select("path", "size_bytes", F.explode(F.slice(F.reverse(ancestors(F.col("path"))), 1, 2)).alias("dir"))
    order = Window.partitionBy("dir").orderBy(F.desc("size_bytes"), "path")
    largest = near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= HEADERS)
    read = largest.select("path").distinct().mapInPandas(run, "path string, family string").where("family is not null")
    first = largest.join(read, "path").groupBy("dir").agg(F.min_by("family", "nth").alias("family"))
    return first.join(near.groupBy("dir").agg(F.count("*").alias("n_tables")), "dir")


def evidence(files: DataFrame, families: DataFrame | None = None) -> DataFrame:
    """(dir, known, named, signals, score, format, anchored, children, qualifies) of all folders above files(path, size_bytes).

    signals: (weight, format, says) of each observation; format is that of the
    heaviest, the first of equal ones; anchored folders hold evidence themselves.
    """
    rows = files.select(F.lower(name_of(F.col("path"))).alias("name"), extension_of(F.col("path")).alias("ext"), F.reverse(ancestors(F.col("path"))).alias("above"))
    rows = rows.withColumn("file_known", known_dataset(F.col("name"))).select("*", F.posexplode("above").alias("up", "dir")).drop("above")
    direct, near = F.col("up") == 0, F.col("up") <= 1
    words = F.split("name", "[^a-z0-9]+")
    telling = F.col("ext").isin(*CAPTURES, *FLOWS, *EVENT_LOGS) | F.col("name").isin(*ZEEK, *SURICATA, *SNORT, *HOST_LOGS) | F.col("name").rlike(DIGEST_NAME) | F.col("file_known").isNotNull()
    counts = rows.groupBy("dir").agg(
        F.count_if(F.col("ext").isin(*CAPTURES)).alias("captures"), F.count_if(F.col("ext").isin(*FLOWS)).alias("flows"), F.count_if(F.col("ext").isin(*EVENT_LOGS)).alias("event_logs"), F.count_if(F.col("ext").isin(*SAMPLES)).alias("samples"),
        F.count_distinct(F.when(near & F.col("name").isin(*ZEEK), F.col("name"))).alias("zeek"), F.count_if(near & F.col("name").isin(*SURICATA)).alias("suricata"), F.count_if(near & F.col("name").isin(*SNORT)).alias("snort"),
        F.count_if(near & F.col("name").isin(*HOST_LOGS)).alias("host_logs"), F.count_if(near & F.arrays_overlap(words, F.array(*map(F.lit, INTEL)))).alias("intel"), F.count_if(near & F.col("name").isin(*CHALLENGES)).alias("challenges"),
        F.count_if(near & F.col("name").rlike(DIGEST_NAME)).alias("digests"), F.count_if(near).alias("nearby"), F.max(near & F.col("name").isin(*HASH_LISTS)).alias("hash_list"), F.max(direct & telling).alias("anchored"),
        F.min_by(F.when(direct, F.col("file_known")), F.when(direct & F.col("file_known").isNotNull(), F.col("name"))).alias("file_known"),
    )
    folders = rows.select("dir").distinct()
    parent = F.regexp_replace("dir", "/[^/]*$", "")
    children = folders.where(F.col("dir").contains("/")).groupBy(parent.alias("dir")).agg(F.array_sort(F.collect_set(F.lower(name_of(F.col("dir"))))).alias("children"))
    full = counts.join(children, "dir", "left").withColumn("children", F.coalesce("children", F.array().cast("array<string>")))
    full = full.join(families, "dir", "left") if families is not None else full.withColumns({"family": F.lit(None).cast("string"), "n_tables": F.lit(0)})
    own = F.lower(name_of(F.col("dir")))
    # the deepest folder of the path that names a dataset, then a file's name
    named = F.try_element_at(F.array_compact(F.transform(F.reverse(F.split("dir", "/")), known_dataset)), F.lit(1))
    full = full.withColumn("of_dir", named).withColumn("known", F.coalesce("of_dir", "file_known"))
    marked = own.isin(*MALWARE_FOLDERS) | F.arrays_overlap("children", F.array(*map(F.lit, MALWARE_FOLDERS)))
    corpus = (F.col("digests") >= LEAST_DIGESTS) & (F.col("digests") >= LEAST_DIGEST_SHARE * F.col("nearby"))
    pair = F.lit(False)
    for a, b in CLASS_PAIRS:
        pair = pair | (F.array_contains("children", a) & F.array_contains("children", b))
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    strong = flag(marked) + flag(corpus) + flag(F.col("known.format") == "malware")
    agreeing = strong + flag(pair) + flag(F.col("samples") >= 50) + flag(F.col("hash_list"))
    malware = (strong > 0) & (agreeing >= 2) & ((F.col("digests") >= 5) | (F.col("samples") >= 10) | pair)

    def signal(when: Column, weight: Column | float, of: Column | str | None, says: str) -> Column:
        weight = weight if isinstance(weight, Column) else F.lit(weight)
        of = of if isinstance(of, Column) else F.lit(of).cast("string")
        return F.when(when, F.struct(weight.cast("double").alias("weight"), of.alias("format"), F.lit(says).alias("says")))

    plural = lambda c: F.when(F.col(c) >= 3, 4.0).otherwise(3.0)
    signals = F.array_compact(F.array(
        signal(F.col("known").isNotNull(), 2.5, F.col("known.format"), "known dataset"), signal(F.col("captures") > 0, plural("captures"), "network_capture", "packet captures"), signal(F.col("flows") > 0, plural("flows"), "network_flow", "flow records"),
        signal(F.col("zeek") >= 2, 4.0, "network_flow", "Zeek logs"), signal(F.col("zeek") == 1, 1.5, None, "a Zeek log"), signal(F.col("suricata") > 0, 3.0, "network_capture", "Suricata output"), signal(F.col("snort") > 0, 2.5, "network_capture", "Snort output"),
        signal(F.col("event_logs") > 0, plural("event_logs"), "host_log", "Windows event logs"), signal(F.col("host_logs") >= 3, 2.5, "host_log", "host telemetry"), signal(malware, 2.5 + agreeing, "malware", "malware corpus"),
        signal(F.col("intel") >= 2, F.when(F.col("intel") >= 5, 3.0).otherwise(2.0), "threat_intel", "indicator files"), signal(F.lower("dir").rlike("|".join(map(re.escape, CTF))) & (F.col("challenges") > 0), 3.0, "ctf", "challenges"),
        signal(F.col("family").isNotNull(), 4.0, "intrusion_detection", "intrusion columns"), signal(F.col("family").isNotNull() & (F.col("n_tables") > 1), 1.0, None, "tables of one layout"),
    ))
    full = full.withColumn("signals", signals).withColumn("score", F.aggregate("signals", F.lit(0.0), lambda s, x: s + x["weight"]))
    heaviest = F.array_max(F.transform(F.filter("signals", lambda x: x["format"].isNotNull()), lambda x: x["weight"]))
    best = F.try_element_at(F.filter("signals", lambda x: x["format"].isNotNull() & (x["weight"] == heaviest)), F.lit(1))
    enough = (F.size("signals") >= LEAST_SIGNALS) | F.exists("signals", lambda x: x["weight"] >= LEAST_SCORE)
    anchored = F.col("anchored") | F.col("family").isNotNull()
    return full.select("dir", F.col("known.label").alias("known"), F.col("of_dir").isNotNull().alias("named"), "signals", "score", F.coalesce(best["format"], F.lit("custom")).alias("format"), anchored.alias("anchored"), "children", ((F.col("score") >= LEAST_SCORE) & enough).alias("qualifies"))


def security_folders(files: DataFrame, families: DataFrame | None = None) -> DataFrame:
    """(path, name, format, score, confidence, signals) of the folders that are security datasets.

    A folder with a container's name that holds no evidence itself isn't one
    unless its dataset is known. One without evidence of its own hands the claim
    to qualifying folders right below, unless these are splits.
    """
    judged = evidence(files, families).where("qualifies")
    below = judged.select(F.regexp_replace("dir", "/[^/]*$", "").alias("dir")).distinct().withColumn("deeper", F.lit(True))
    splits = F.size(F.array_intersect("children", F.array(*map(F.lit, SPLIT_FOLDERS)))) >= 2
    held = judged.join(below, "dir", "left").where(F.col("anchored") | F.col("known").isNotNull() | ~F.lower(name_of(F.col("dir"))).isin(*CONTAINERS))
    held = held.where(F.col("anchored") | splits | F.col("deeper").isNull())
    name = F.when(F.col("named"), F.col("known")).otherwise(name_of(F.col("dir")))
    says = F.transform(F.array_sort("signals", lambda a, b: F.signum(b["weight"] - a["weight"]).cast("int")), lambda x: x["says"])
    return held.select(F.col("dir").alias("path"), name.alias("name"), "format", F.round("score", 1).alias("score"), F.least(F.lit(0.99), 0.55 + 0.05 * F.col("score")).alias("confidence"), says.alias("signals"))


def security_hits(files: DataFrame, families: DataFrame | None = None) -> DataFrame:
    """security_folders as hits (path, band, detector, kind, claims) for ``recognise.detected``."""
    return security_folders(files, families).select("path", F.lit(60).alias("band"), F.lit("cybersecurity_dataset").alias("detector"), F.lit("dataset").alias("kind"), F.lit(True).alias("claims"))
