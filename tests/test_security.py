from pyspark.sql import functions as F

from shelfmark.operators import security


def folders(spark, *paths, families=None):
    return {r.path: r for r in security.security_folders(spark.createDataFrame([(p, 10) for p in paths], "path string, size_bytes long"), families).collect()}


def test_weighted_evidence(spark):
    zeek = [f"z/logs/{n}" for n in ("conn.log", "dns.log", "http.log")]
    caps = [f"caps/{i}.pcap" for i in range(3)]
    found = folders(spark, *zeek, *caps, "one/conn.log", "lone/a.pcap", "notes/a.csv", "sets/CIC-IDS2017/a.pcap", "remember/ember.c")
    assert found["z/logs"].format == "network_flow" and found["z/logs"].score == 4.0 and round(found["z/logs"].confidence, 2) == 0.75
    assert found["caps"].signals == ["packet captures"]
    named = found["sets/CIC-IDS2017"]
    assert named.name == "CICIDS2017" and named.score == 5.5 and named.signals == ["packet captures", "known dataset"]
    assert set(found) == {"z/logs", "caps", "sets/CIC-IDS2017"}


def test_malware_needs_more_than_programs(spark):
    digests = [f"vault/malware/{i:032x}" for i in range(25)]
    found = folders(spark, *digests, *[f"app/{i}.dll" for i in range(80)])
    assert found["vault/malware"].format == "malware" and not any(p.startswith("app") for p in found)


def test_known_names(spark):
    names = ["UNSW_NB15_1.csv", "KDD-Cup 99", "darpa1998", "remember.c", "PKCS7_type_is_other.gz", "ember", ""]
    rows = spark.createDataFrame(list(enumerate(names)), "i int, n string").withColumn("k", security.known_dataset(F.col("n"))["label"]).orderBy("i").collect()
    assert [r.k for r in rows] == ["UNSW-NB15", "KDD Cup 99", "DARPA", None, None, "EMBER", None]


def test_table_headers(spark, tmp_path):
    flows = tmp_path / "flows"
    flows.mkdir()
    (flows / "a.csv").write_text('Src_IP,"dst_ip", src_port,x\n' + "1,2,3,4\n" * 1000)
    (flows / "b.csv").write_text("a,b,c\n" + "1,2,3\n" * 1000)
    files = spark.createDataFrame([(str(flows / n), 5000) for n in ("a.csv", "b.csv", "gone.csv")], "path string, size_bytes long")
    families = security.table_families(files)
    assert {r.dir: (r.family, r.n_tables) for r in families.collect()} == {str(flows): ("generic flow", 3), str(tmp_path): ("generic flow", 3)}
    found = {r.path: r for r in security.security_folders(files, families).collect()}
    assert found[str(flows)].format == "intrusion_detection" and found[str(flows)].score == 5.0
