"""Sample lines of the bundled sources, written for these tests, and a raw-event builder."""

from pyspark.sql import functions as F

NS = 1_000_000_000
INGEST = 1_790_000_000 * NS  # September 2026

SAMPLES = {
    "fortigate_traffic": '<189>date=2026-05-01 time=10:20:30 devname="edge" logid="0000000013" type="traffic" level="warning" srcip=192.0.2.5 srcport=4000 '
    'srcintf="lan" dstip=198.51.100.8 dstport=443 dstintf="wan" sessionid=77 proto=6 action="deny" policyid=4 sentbyte=10 rcvdbyte=20 sentpkt=1 rcvdpkt=2 service="HTTPS"',
    "panos_traffic_v10": "<14>1 2026-05-01T10:20:31Z fw - - - - 1,2026/05/01 10:20:31,0099,TRAFFIC,end,1,2026/05/01 10:20:30,192.0.2.5,198.51.100.8,203.0.113.1,198.51.100.8,"
    "web,,,ssl,vsys1,in,out,e1,e2,fwd,,555,1,4000,443,4001,443,0x1,tcp,allow,30,10,20,3,2026/05/01 10:20:00,9,any,0,1,0x0,A,B,0,1,2,aged-out",
    "panos_traffic_v11": "<14>1 2026-05-01T10:20:31Z fw - - - - 1,2026/05/01 10:20:31,0099,TRAFFIC,end,1,2026/05/01 10:20:30,192.0.2.5,198.51.100.8,203.0.113.1,198.51.100.8,"
    "web,,,,ssl,vsys1,in,out,e1,e2,fwd,,555,1,4000,443,4001,443,0x1,tcp,drop,30,10,20,3,2026/05/01 10:20:00,9,any,0,1,0x0,A,B,0,1,2,aged-out,0,1,0",
    "cisco_asa": "<134>May  1 10:20:30 asa1 %ASA-6-302014: Teardown TCP connection 9 for outside:198.51.100.8/443 to inside:192.0.2.5/4000 duration 0:00:10 bytes 42 TCP FINs",
    "iptables": "<4>May  1 10:20:30 gw kernel: act=drop chain=INPUT rule=7 IN=eth0 OUT=eth1 SRC=198.51.100.8 DST=192.0.2.5 LEN=60 TTL=54 DF PROTO=TCP SPT=443 DPT=22 SYN",
    "aws_vpc_flow": "2 123456789012 eni-0ab1 192.0.2.5 198.51.100.8 4000 443 6 3 300 1777630830 1777630890 REJECT OK",
    "suricata_eve_alert": '{"timestamp":"2026-05-01T10:20:30.500000+0000","event_type":"alert","src_ip":"198.51.100.8","src_port":4000,"dest_ip":"192.0.2.5","dest_port":445,"proto":"TCP",'
    '"alert":{"action":"blocked","signature_id":2001,"signature":"ET SCAN probe","category":"Misc","severity":1,"metadata":{"tag":["a","b"]}}}',
    "suricata_eve_flow": '{"timestamp":"2026-05-01T10:20:30.000000+0000","flow_id":5,"event_type":"flow","src_ip":"192.0.2.5","src_port":4000,"dest_ip":"198.51.100.8","dest_port":443,"proto":"UDP",'
    '"app_proto":"quic","flow":{"pkts_toserver":1,"pkts_toclient":2,"bytes_toserver":10,"bytes_toclient":20,"state":"closed"}}',
    "zeek_conn": '{"ts":1777630830.25,"uid":"C1","id.orig_h":"192.0.2.5","id.orig_p":4000,"id.resp_h":"2001:DB8::8","id.resp_p":443,"proto":"tcp","service":"ssl","conn_state":"S0","orig_bytes":10,"resp_bytes":20,"local_orig":true,"tunnel_parents":[]}',
    "zeek_dns": '{"ts":1777630830.25,"uid":"C2","id.orig_h":"192.0.2.5","id.orig_p":4000,"id.resp_h":"198.51.100.8","id.resp_p":53,"proto":"udp","query":"bad.example","qclass_name":"C_INTERNET","qtype_name":"A","rcode":3,"rcode_name":"NXDOMAIN","answers":["x"]}',
    "zeek_http": '{"ts":1777630830.25,"uid":"C3","id.orig_h":"192.0.2.5","id.orig_p":4000,"id.resp_h":"198.51.100.8","id.resp_p":80,"method":"POST","host":"www.example","uri":"/a","status_code":404,"response_body_len":9,"tags":[]}',
}


def raw_events(spark, lines, source="dev"):
    """Raw events of text or byte lines with ids ``u0, u1, ..``."""
    rows = [(f"u{i}", bytearray(x.encode() if isinstance(x, str) else x), source) for i, x in enumerate(lines)]
    df = spark.createDataFrame(rows, "event_uid string, raw binary, source_id string")
    return df.select("event_uid", "raw", F.sha2("raw", 256).alias("raw_hash"), F.octet_length("raw").alias("raw_len"),
                     F.lit(INGEST).cast("bigint").alias("ingest_time_ns"), "source_id", F.lit("file").alias("transport"), F.lit(None).cast("string").alias("peer"))
