"""The eleven bundled sources, composed from shared pieces."""

from __future__ import annotations

from functools import lru_cache

from rampart.definitions import Activity, Definition, Field, ordered

# Protocol names and numbers as the sources write them.
NUMBER_OF = {"tcp": 6, "udp": 17, "icmp": 1, "ipv6-icmp": 58, "gre": 47, "esp": 50}


def _plain(path: str, source: str, kind: str = "str", required: bool = False) -> Field:
    return Field(path, (source,), kind, required=required)


def _mapped(path: str, source, values: dict, default=None) -> Field:
    return Field(path, (source,) if isinstance(source, str) else tuple(source), values=values, default=default)


def _ends(src: tuple[str, str], dst: tuple[str, str], src_if: str | None = None, dst_if: str | None = None) -> list[Field]:
    """Address and port of both ends, with interfaces where the source has them."""
    out = []
    for role, (ip, port), intf in (("src", src, src_if), ("dst", dst, dst_if)):
        out += [_plain(f"{role}_endpoint.ip", ip, "ip", True), _plain(f"{role}_endpoint.port", port, "int")]
        out += [_plain(f"{role}_endpoint.interface_name", intf)] if intf else []
    return out


def _counts(**sources: str) -> list[Field]:
    return [_plain(f"traffic.{name}", source, "int") for name, source in sources.items()]


def _protocol(source: str, spelled: dict[str, str], number_default=0) -> list[Field]:
    """Protocol name and number from the spellings one source uses."""
    return [
        _mapped("connection_info.protocol_name", source, spelled),
        _mapped("connection_info.protocol_num", source, {s: NUMBER_OF[n] for s, n in spelled.items()}, number_default),
    ]


def _when(source: str, fmt: str | None = None) -> Field:
    return Field("time", (source,), "timestamp", format=fmt, tz="UTC" if fmt else None, required=True)


def _product(vendor: str, name: str, **more) -> dict:
    return {"metadata.product.vendor_name": vendor, "metadata.product.name": name, **more}


FLOW_REQUIRED = ("src_endpoint.ip", "dst_endpoint.ip", "time", "class_uid", "category_uid")


def _source(name, vendor, product, product_version, priority, detect, engine, fields, constants, activity,
            class_uid=4001, category_uid=4, required=FLOW_REQUIRED, unmapped="keep_all", **parse) -> Definition:
    return Definition(
        name=name, version="1.0.0", vendor=vendor, product=product, product_version=product_version, detect=detect,
        engine=engine, class_uid=class_uid, category_uid=category_uid, activity=activity, fields=tuple(fields),
        constants=constants, unmapped=unmapped, required=required, priority=priority, **parse,
    )


def _all(*rules) -> dict:
    return {"all": list(rules)}


def fortigate() -> Definition:
    levels = {"emergency": 6, "alert": 5, "critical": 5, "error": 4, "warning": 3,
              "notification": 1, "notice": 1, "information": 1, "informational": 1, "debug": 1}
    fields = [
        *_ends(("srcip", "srcport"), ("dstip", "dstport"), "srcintf", "dstintf"),
        _plain("connection_info.uid", "sessionid"),
        _plain("connection_info.protocol_num", "proto", "int"),
        _mapped("connection_info.protocol_name", "proto", {"6": "TCP", "17": "UDP", "1": "ICMP"}),
        _mapped("action_id", "action", {"accept": 1, "start": 1, "close": 1, "timeout": 1, "server-rst": 1, "client-rst": 1, "deny": 2}, 0),
        _mapped("action", "action", {"accept": "Allowed", "start": "Allowed", "close": "Allowed", "timeout": "Allowed", "server-rst": "Allowed", "client-rst": "Allowed", "deny": "Denied"}, "Unknown"),
        _mapped("activity_name", "action", {"accept": "Open", "start": "Open", "close": "Close", "timeout": "Close",
                                            "server-rst": "Reset", "client-rst": "Reset", "deny": "Traffic"}, "Unknown"),
        _mapped("disposition", "action", {"accept": "Allowed", "close": "Allowed", "deny": "Blocked", "server-rst": "Reset", "client-rst": "Reset"}),
        *_counts(bytes_out="sentbyte", bytes_in="rcvdbyte", packets_out="sentpkt", packets_in="rcvdpkt"),
        _plain("firewall_rule.uid", "policyid"),
        _mapped("severity_id", "level", levels, 1),
        Field("time", ("date", "time"), "timestamp", format="%Y-%m-%d %H:%M:%S", tz="UTC", join=" ", required=True),
    ]
    activity = Activity("action", {"accept": 1, "start": 1, "close": 2, "timeout": 2, "deny": 6, "server-rst": 3, "client-rst": 3}, 0)
    return _source("fortigate_traffic", "Fortinet", "FortiGate", "7.x", 20,
                   _all({"contains": "logid="}, {"regex": r'\btype="?traffic"?'}), "kv", fields,
                   _product("Fortinet", "FortiGate", status_id=1), activity, envelope="syslog")


def panos(release: str, width: int, columns: str) -> Definition:
    fields = [
        *_ends(("src_ip", "src_port"), ("dst_ip", "dst_port")),
        _plain("app_name", "app"),
        _plain("connection_info.uid", "session_id"),
        *_protocol("protocol", {"tcp": "tcp", "udp": "udp", "icmp": "icmp", "6": "tcp", "17": "udp", "1": "icmp"}),
        _mapped("action_id", "action", {"allow": 1, "deny": 2, "drop": 2, "reset-both": 2, "reset-client": 2, "reset-server": 2}, 0),
        _mapped("action", "action", {"allow": "Allowed", "deny": "Denied", "drop": "Denied", "reset-both": "Denied", "reset-client": "Denied", "reset-server": "Denied"}, "Unknown"),
        _mapped("disposition", "action", {"allow": "Allowed", "deny": "Blocked", "drop": "Dropped",
                                          "reset-both": "Reset", "reset-client": "Reset", "reset-server": "Reset"}),
        _plain("firewall_rule.name", "rule_name"),
        *_counts(bytes_out="bytes_sent", bytes_in="bytes_received", packets="packets",
                 packets_out="packets_sent", packets_in="packets_received"),
        _when("generated_time", "%Y/%m/%d %H:%M:%S"),
    ]
    detect = _all({"contains": ",TRAFFIC,"}, {"regex": r"\d{4}/\d{2}/\d{2}[ T]\d{2}:\d{2}:\d{2},\d+,TRAFFIC,"},
                  {"field_count": {"delimiter": ",", "equals": width}})
    keep = tuple(f"nat_{side}_{what}" for what in ("ip", "port") for side in ("src", "dst")) + ("src_zone", "dst_zone")
    return _source(f"panos_traffic_v{release}", "Palo Alto Networks", "PAN-OS", f"{release}.x", 20, detect, "csv", fields,
                   _product("Palo Alto Networks", "PAN-OS", severity_id=1, status_id=1), 6, unmapped=keep,
                   envelope="syslog", options={"column_map": {"product": "panos_traffic", "version": columns}})


def _asa_end(role: str, mapped: bool = False, port: str = "/{}") -> str:
    """``interface:address/port`` of one end as the appliance writes it, with the translated address in brackets where it adds one."""
    place = lambda prefix: f"%{{IP:{prefix}{role}_ip}}" + port.format(f"%{{INT:{prefix}{role}_port}}")
    return f"%{{ZONE:{role}_iface}}:" + place("") + (rf" \({place('xlate_')}\)" if mapped else "")


def _asa_messages() -> dict[str, list[str]]:
    """Texts by message number, from the vendor's catalogue. ``for`` names the end that opened an inbound connection and the one that was called by an outbound one."""
    src, dst = _asa_end("src", mapped=True), _asa_end("dst", mapped=True)
    loose = r"(?:/{})?"  # no ports without TCP or UDP
    built = "Built %{{{0}:asa_direction}} %{{CARRIED:proto}} connection %{{INT:conn_id}} for {1} to {2}"
    return {
        "302013": [built.format("TO_INSIDE", src, dst), built.format("TO_OUTSIDE", dst, src)],
        "302014": [f"Teardown %{{CARRIED:proto}} connection %{{INT:conn_id}} for {_asa_end('dst')} to {_asa_end('src')} duration %{{NOTSPACE:duration}} bytes %{{INT:bytes}}(?: %{{GREEDYDATA:teardown_reason}})?"],
        "106023": [rf'Deny %{{CARRIED:proto}} src {_asa_end("src", port=loose)} dst {_asa_end("dst", port=loose)} by access-group "%{{DATA:acl_name}}" \[%{{DATA:acl_hash}}\]'],
    }


def asa() -> Definition:
    # fixed values: the names of captured fields, since unmapped ones appear in records under them
    patterns = {"ZONE": r"[^\s:]+", "CARRIED": r"(?:[A-Za-z]+|[0-9]{1,3})", "TO_INSIDE": "inbound", "TO_OUTSIDE": "outbound"}
    texts = [f"(?:{text})" for forms in _asa_messages().values() for text in forms]
    pattern = r"%{SYSLOGTIMESTAMP:ts} %{HOSTNAME:fw_host} %ASA-%{INT:asa_severity}-%{INT:event_code}: (?:" + "|".join(texts) + ")"
    names = {"TCP": "tcp", "tcp": "tcp", "UDP": "udp", "udp": "udp", "ICMP": "icmp", "icmp": "icmp",
             "6": "tcp", "17": "udp", "1": "icmp"}
    numbers = {**{w: NUMBER_OF[w.lower()] for w in "TCP tcp UDP udp ICMP icmp GRE gre ESP esp".split()},
               **{str(n): n for n in (1, 6, 17, 47, 50)}}
    only_deny = lambda path, hit, other: _mapped(path, "event_code", {"106023": hit}, other)
    fields = [
        _plain("metadata.event_code", "event_code"),
        *_ends(("src_ip", "src_port"), ("dst_ip", "dst_port")),
        _plain("connection_info.uid", "conn_id"),
        _mapped("connection_info.protocol_name", "proto", names),
        _mapped("connection_info.protocol_num", "proto", numbers, 0),
        _mapped("connection_info.direction_id", "asa_direction", {"outbound": 2, "inbound": 1}, 0),
        _mapped("connection_info.direction", "asa_direction", {"outbound": "Outbound", "inbound": "Inbound"}, "Unknown"),
        _mapped("severity_id", "asa_severity", {"0": 6, "1": 5, "2": 5, "3": 4, "4": 3, "5": 2, "6": 1, "7": 1}, 1),
        _mapped("activity_name", "event_code", {"302013": "Open", "302014": "Close", "106023": "Traffic"}, "Unknown"),
        only_deny("action_id", 2, 1), only_deny("action", "Denied", "Allowed"), only_deny("disposition", "Blocked", "Allowed"),
        _plain("firewall_rule.name", "acl_name"),
        *_counts(bytes="bytes"),
        _when("ts"),
    ]
    return _source("cisco_asa", "Cisco", "ASA", "9.x", 20, {"regex": rf"%ASA-\d-(?:{'|'.join(_asa_messages())}):"}, "grok", fields,
                   _product("Cisco", "Cisco ASA", status_id=1),
                   Activity("event_code", {"302013": 1, "302014": 2, "106023": 6}, 0),
                   options={"patterns": patterns, "pattern": pattern})


def iptables() -> Definition:
    verdict = ("act", "action", "prefix")
    names = {"TCP": "tcp", "UDP": "udp", "ICMP": "icmp", "ICMPV6": "ipv6-icmp", "6": "tcp", "17": "udp", "1": "icmp"}
    fields = [
        *_ends(("SRC", "SPT"), ("DST", "DPT"), "IN", "OUT"),
        _mapped("connection_info.protocol_name", "PROTO", names),
        _mapped("connection_info.protocol_num", "PROTO", {**{k: NUMBER_OF[v] for k, v in names.items()}, "58": 58}, 0),
        _mapped("action_id", verdict, {"drop": 2, "DROP": 2, "deny": 2, "DENY": 2, "reject": 2, "REJECT": 2, "block": 2, "BLOCK": 2, "accept": 1, "ACCEPT": 1, "allow": 1, "ALLOW": 1, "pass": 1, "PASS": 1}, 0),
        _mapped("action", verdict, {"drop": "Denied", "DROP": "Denied", "deny": "Denied", "DENY": "Denied", "reject": "Denied", "REJECT": "Denied", "block": "Denied", "BLOCK": "Denied", "accept": "Allowed", "ACCEPT": "Allowed", "allow": "Allowed", "ALLOW": "Allowed", "pass": "Allowed", "PASS": "Allowed"}),
        _mapped("disposition", verdict, {"drop": "Dropped", "DROP": "Dropped", "reject": "Dropped", "REJECT": "Dropped", "deny": "Blocked", "DENY": "Blocked", "block": "Blocked", "BLOCK": "Blocked",
                                         "accept": "Allowed", "ACCEPT": "Allowed", "allow": "Allowed", "ALLOW": "Allowed", "pass": "Allowed", "PASS": "Allowed"}),
        _plain("firewall_rule.uid", "rule"), _plain("firewall_rule.name", "chain"),
        *_counts(bytes="LEN"),
        _when("envelope.timestamp"),
    ]
    detect = _all(*({"contains": f"{k}="} for k in ("SRC", "DST", "PROTO")))
    return _source("iptables", "Linux", "netfilter", "iptables/nftables", 30, detect, "kv", fields,
                   _product("Linux", "netfilter", severity_id=1, status_id=1), 6, envelope="syslog")


def vpc_flow() -> Definition:
    columns = ("version account_id interface_id srcaddr dstaddr srcport dstport protocol packets bytes start end "
               "action log_status").split()
    either = lambda path, a, r, d=None: _mapped(path, "action", {"ACCEPT": a, "REJECT": r}, d)
    fields = [
        *_ends(("srcaddr", "srcport"), ("dstaddr", "dstport")),
        _plain("connection_info.protocol_num", "protocol", "int"),
        _mapped("connection_info.protocol_name", "protocol", {str(n): name for name, n in NUMBER_OF.items()}),
        either("action_id", 1, 2, 0), either("action", "Allowed", "Denied"), either("disposition", "Allowed", "Blocked"),
        _mapped("status_id", "log_status", {"OK": 1, "NODATA": 0, "SKIPDATA": 2}, 0),
        *_counts(bytes="bytes", packets="packets"),
        _when("start"),
    ]
    return _source("aws_vpc_flow", "Amazon Web Services", "VPC Flow Logs", "2", 30,
                   _all({"starts_with": "2 "}, {"regex": r"^2 \d{12} eni-[0-9a-f]+ "}), "csv", fields,
                   _product("Amazon Web Services", "VPC Flow Logs", severity_id=1), 6,
                   options={"delimiter": " ", "columns": columns})


def _eve(kind: str, **rest) -> Definition:
    detect = _all({"contains": '"event_type"'}, {"field_equals": {"name": "event_type", "value": kind}})
    return _source(f"suricata_eve_{kind}", "OISF", "Suricata", "7.x", 15, detect, "json", **rest)


_EVE_ENDS = (("src_ip", "src_port"), ("dest_ip", "dest_port"))


def suricata_alert() -> Definition:
    fields = [
        _plain("finding_info.uid", "alert.signature_id", required=True),
        _plain("finding_info.title", "alert.signature"), _plain("finding_info.types", "alert.category"),
        _mapped("severity_id", "alert.severity", {"1": 4, "2": 3, "3": 2, "4": 1}, 3),
        _mapped("action_id", "alert.action", {"allowed": 1, "pass": 1, "blocked": 2, "dropped": 2, "drop": 2, "reject": 2}, 0),
        _mapped("action", "alert.action", {"allowed": "Allowed", "pass": "Allowed", "blocked": "Denied", "dropped": "Denied", "drop": "Denied", "reject": "Denied"}, "Unknown"),
        _mapped("disposition", "alert.action", {"allowed": "Allowed", "blocked": "Blocked", "reject": "Blocked",
                                                "dropped": "Dropped", "drop": "Dropped"}),
        *_ends(*_EVE_ENDS), _when("timestamp"),
    ]
    constants = _product("OISF", "Suricata", status_id=1)
    constants |= {"finding_info.analytic.name": "Suricata", "finding_info.analytic.type": "Rule", "finding_info.analytic.type_id": 1}
    return _eve("alert", fields=fields, constants=constants, activity=1, class_uid=2004, category_uid=2,
                required=("finding_info", "src_endpoint.ip", "time", "class_uid", "category_uid"))


def suricata_flow() -> Definition:
    fields = [
        *_ends(*_EVE_ENDS), _plain("app_name", "app_proto"),
        _plain("connection_info.uid", "flow_id"), _plain("connection_info.tcp_flags", "tcp.tcp_flags"),
        *_protocol("proto", {"TCP": "tcp", "UDP": "udp", "ICMP": "icmp", "6": "tcp", "17": "udp", "1": "icmp"}),
        *_counts(bytes_out="flow.bytes_toserver", bytes_in="flow.bytes_toclient",
                 packets_out="flow.pkts_toserver", packets_in="flow.pkts_toclient"),
        _when("timestamp"),
    ]
    states = Activity("flow.state", {"new": 1, "established": 6, "closed": 2, "bypassed": 6, "local_bypassed": 6}, 6)
    return _eve("flow", fields=fields, activity=states,
                constants=_product("OISF", "Suricata", severity_id=1, status_id=1, action_id=1, action="Allowed"))


def _zeek(kind: str, marker: str, fields: list[Field], **rest) -> Definition:
    ends = _ends(("id.orig_h", "id.orig_p"), ("id.resp_h", "id.resp_p"))
    return _source(f"zeek_{kind}", "The Zeek Project", "Zeek", "6.x", 15, _all({"contains": '"uid"'}, {"contains": f'"{marker}"'}),
                   "json", [*ends, *fields, _plain("connection_info.uid", "uid"), _when("ts")], **rest)


def _zeek_product(**more) -> dict:
    return _product("The Zeek Project", "Zeek", severity_id=1, status_id=1, **more)


def zeek_conn() -> Definition:
    states = {"S0": 4, "S1": 1, "S2": 1, "S3": 1, "SF": 2, "REJ": 5, "RSTO": 3, "RSTR": 3, "RSTOS0": 3, "RSTRH": 3, "SH": 4, "SHR": 4, "OTH": 6}
    fields = [
        _plain("app_name", "service"), *_protocol("proto", {n: n for n in ("tcp", "udp", "icmp")}),
        *_counts(bytes_out="orig_bytes", bytes_in="resp_bytes", packets_out="orig_pkts", packets_in="resp_pkts"),
    ]
    return _zeek("conn", "conn_state", fields, activity=Activity("conn_state", states, 6),
                 constants=_zeek_product(action_id=1, action="Allowed"))


def zeek_dns() -> Definition:
    classes = {"C_INTERNET": "IN", "C_CHAOS": "CH", "C_HS": "HS", "C_NONE": "NONE", "C_ANY": "ANY"}
    codes = {"NOERROR": "NoError", "FORMERR": "FormError", "SERVFAIL": "ServError", "NXDOMAIN": "NXDomain",
             "NOTIMP": "NotImp", "REFUSED": "Refused"}
    fields = [
        _plain("query.hostname", "query", required=True), _plain("query.type", "qtype_name"),
        _mapped("query.class", "qclass_name", classes), _plain("rcode_id", "rcode", "int"), _mapped("rcode", "rcode_name", codes),
        *_protocol("proto", {"tcp": "tcp", "udp": "udp"}),
    ]
    return _zeek("dns", "query", fields, activity=2, class_uid=4003, constants=_zeek_product(),
                 required=("query", "src_endpoint.ip", "time", "class_uid", "category_uid"))


def zeek_http() -> Definition:
    methods = {m: i for i, m in enumerate("CONNECT DELETE GET HEAD OPTIONS POST PUT TRACE".split(), start=1)}
    parts = {"http_method": "method", "version": "version", "user_agent": "user_agent", "referrer": "referrer",
             "url.hostname": "host", "url.path": "uri"}
    fields = [*(_plain(f"http_request.{k}", v) for k, v in parts.items()),
              _plain("http_response.code", "status_code", "int"), _plain("http_response.length", "response_body_len", "int")]
    return _zeek("http", "uri", fields, activity=Activity("method", methods, 99), class_uid=4002,
                 constants=_zeek_product(**{"http_request.url.scheme": "http"}),
                 required=("http_request", "src_endpoint.ip", "time", "class_uid", "category_uid"))


@lru_cache(maxsize=1)
def _bundled() -> tuple[Definition, ...]:
    return tuple(ordered([
        fortigate(), panos("10", 47, "10.1"), panos("11", 51, "11.0"), asa(), iptables(), vpc_flow(),
        suricata_alert(), suricata_flow(), zeek_conn(), zeek_dns(), zeek_http(),
    ]))


def bundled() -> list[Definition]:
    """All bundled definitions in match order."""
    return list(_bundled())
