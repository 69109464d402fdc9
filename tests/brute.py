"""Row-at-a-time reference implementations that share no code with the library."""

from __future__ import annotations

import json
import re
import unicodedata
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

ABBR = {"UTC": 0, "GMT": 0, "Z": 0, "EST": -5, "EDT": -4, "PST": -8, "PDT": -7, "CET": 1, "CEST": 2, "KST": 9, "AEST": 10, "AEDT": 11}
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
CANONICAL = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}\+00:00")
SYMMETRIC = {"knows", "partnerof", "collaborateswith", "siblingof", "relatedto", "similarto"}


def fold(s):
    return "".join(c for c in s.lower() if unicodedata.category(c)[0] in "LN")


def instant(text, zone, order):
    """Microseconds or None."""
    if text is None:
        return None
    v = text.strip()
    num = lambda y, mo, d, h=0, mi=0, s=0, f="": (datetime(int(y), int(mo), int(d), int(h or 0), int(mi or 0), int(s or 0)), int(((f or "") + "000000")[:6]))
    hour12 = lambda h, half: None if not 1 <= int(h) <= 12 else int(h) % 12 + 12 * (half.lower() in ("pm", "오후"))
    try:
        if m := re.fullmatch(r"(\d{10})(?:\.(\d+))?", v):
            return int(m[1]) * 10**6 + int(((m[2] or "") + "000000")[:6])
        if re.fullmatch(r"\d{13}", v):
            return int(v) * 1000
        tz = None
        if m := re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)(?:[T ](\d\d):(\d\d)(?::(\d\d)(?:\.(\d+))?)?(.*))?", v) or re.fullmatch(r"(\d{4})(\d\d)(\d\d)(?:T(\d\d)(\d\d)(\d\d)()(.*))?", v):
            t, us = num(*m.groups()[:7])
            tz = (m[8] or "").strip()
        elif m := re.fullmatch(r"(\d{4})/(\d\d?)/(\d\d?)(?: (\d\d):(\d\d):(\d\d))?", v):
            t, us = num(*m.groups())
        elif m := re.fullmatch(r"(\d\d?)/(\d\d?)/(\d{4}) (\d\d?):(\d\d)(?: ([AaPp][Mm]))?", v):
            d, mo = (m[2], m[1]) if order == "MDY" else (m[1], m[2])
            t, us = num(m[3], mo, d, hour12(m[4], m[6]) if m[6] else m[4], m[5])
        elif m := re.fullmatch(r"(\d\d?)\.(\d\d?)\.(\d{4})(?: (\d\d):(\d\d):(\d\d))?", v):
            t, us = num(m[3], m[2], m[1], m[4], m[5], m[6])
        elif m := re.fullmatch(r"(?:\w{3}, )?(\d\d?) (\w{3}) (\d{4}) (\d\d):(\d\d)(?::(\d\d))?(.*)", v):
            t, us = num(m[3], MONTHS.index(m[2]) + 1, m[1], m[4], m[5], m[6])
            tz = m[7].strip()
        elif m := re.fullmatch(r"(\w{3}) (\d\d?), (\d{4}) (\d\d?):(\d\d) ([ap]m)", v):
            t, us = num(m[3], MONTHS.index(m[1]) + 1, m[2], hour12(m[4], m[6]), m[5])
        elif m := re.fullmatch(r"(\d{4})년 (\d\d?)월 (\d\d?)일 (오전|오후) (\d\d?):(\d\d)", v):
            t, us = num(m[1], m[2], m[3], hour12(m[5], m[4]), m[6])
        else:
            return None
    except (ValueError, TypeError):
        return None
    if not tz:
        offset = t.replace(tzinfo=ZoneInfo(zone or "UTC"), fold=0).utcoffset()
    elif m := re.fullmatch(r"(?:GMT)?([+-])(\d\d):?(\d\d)", tz):
        offset = timedelta(minutes=(int(m[2]) * 60 + int(m[3])) * (-1 if m[1] == "-" else 1))
    elif tz in ABBR:
        offset = timedelta(hours=ABBR[tz])
    else:
        offset = t.replace(tzinfo=ZoneInfo(tz.strip("[]")), fold=0).utcoffset()
    return (t.replace(tzinfo=timezone.utc) - EPOCH - offset) // timedelta(microseconds=1) + us


def of_agent(agents):
    return {a["agent"]: (a["time_zone"], a["date_order"]) for a in agents}


def p1(edges, nodes, agents):
    who, parents = of_agent(agents), {}
    for n in nodes:
        if n["id"] and n["id"].strip():
            try:
                dead = json.loads(n["metadata"] or "{}").get("tombstoned") is True
            except ValueError:
                dead = False
            p = parents.setdefault(fold(n["id"]), [False, None])
            p[0] |= dead
            us = instant(n["created_at"], None, None)
            p[1] = us if p[1] is None else min(p[1], us)
    out = set()
    for e in edges:
        us = instant(e["created_at"], *who.get(e["agent"], (None, None)))
        month = "unknown" if us is None else (EPOCH + timedelta(microseconds=us)).strftime("%Y-%m")
        for f in ("from_id", "to_id"):
            if e[f] and e[f].strip():
                p = parents.get(fold(e[f]))
                reason = "missing" if p is None else "deleted" if p[0] else "late" if us is not None and p[1] > us else None
                if reason:
                    out.add((e["id"], f, reason, month))
    return out


def p2(tables, agents):
    who, out = of_agent(agents), set()
    for name, key, fields in (("edges", "id", ("created_at", "valid_from")), ("nodes", "node_no", ("updated_at",)), ("aliases", "alias_no", ("created_at",))):
        for r in tables[name]:
            for f in fields:
                us = instant(r[f], *who.get(r["agent"], (None, None)))
                if us is not None and not CANONICAL.fullmatch(r[f]):
                    out.add((name, r[key], f, us))
    return out


def intervals(edges, agents):
    who = of_agent(agents)
    for e in edges:
        if e["graph_type"] == "temporal" and e["from_id"] and e["from_id"].strip():
            a = instant(e["valid_from"], *who.get(e["agent"], (None, None)))
            u = e["valid_until"]
            b = 10**19 if u is None or u.strip().lower() in ("", "now", "none") else instant(u, None, None)
            if a is not None and b is not None and b > a:
                yield fold(e["from_id"]), fold(e["relation"] or ""), a, b, e, instant(e["created_at"], *who.get(e["agent"], (None, None)))


def p5(edges, agents):
    groups, out = {}, set()
    for k, r, a, b, *_ in intervals(edges, agents):
        groups.setdefault((k, r), []).append((a, b))
    shown = lambda x: -1 if x == 10**19 else x
    for k, spans in groups.items():
        spans.sort()
        start, end = spans[0]
        for a, b in spans[1:]:
            if a > end:
                out |= {(*k, "period", start, shown(end)), (*k, "gap", end, a)}
                start, end = a, b
            end = max(end, b)
        out.add((*k, "period", start, shown(end)))
    return out


def p6(edges, agents):
    groups, out = {}, set()
    for k, r, a, b, e, created in intervals(edges, agents):
        if r in ("livesin", "worksat", "reportsto", "holdsrole") and e["to_id"] and e["to_id"].strip():
            state = (-(10**19) if created is None else created, e["id"], fold(e["to_id"]), b)
            g = groups.setdefault((k, r), {})
            g[a] = max(g.get(a, state), state)
    for k, g in groups.items():
        starts, rows = sorted(g), []
        for i, a in enumerate(starts):
            end = min(g[a][3], starts[i + 1] if i + 1 < len(starts) else 10**19)
            if rows and rows[-1][0] == g[a][2] and rows[-1][2] == a:
                rows[-1][2] = end
            else:
                rows.append([g[a][2], a, end])
        out |= {(*k, v, a, -1 if b == 10**19 else b) for v, a, b in rows}
    return out
