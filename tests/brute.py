"""Slow and plain versions of the operators, over lists of dicts, that share no code with them."""

import datetime as dt
import json
import re
from collections import Counter, defaultdict
from statistics import median
from zoneinfo import ZoneInfo, available_timezones

COLUMNS = "c_bool c_byte c_short c_int c_long c_float c_double c_dec c_date c_str c_varchar c_char".split()
ZONES = {z.upper(): z for z in available_timezones()}
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def by_feed(files):
    once = {}
    for f in sorted(files, key=lambda f: f["registered_at"]):
        once.setdefault(f["file_id"], f)
    feeds = defaultdict(list)
    for f in once.values():
        feeds[f["feed_id"]].append(f)
    for v in feeds.values():
        v.sort(key=lambda f: f["written_at"])
    return once, feeds


def trees(types):
    out = defaultdict(dict)
    for x in types:
        out[x["file_id"]][x["type_id"]] = (x["kind"].upper(), x["subtypes"] or [], x["field_names"] or [])
    return out


def named_children(tree, at):
    kind, subs, names = tree[at]
    if kind == "LIST":
        names = ["item"]
    elif kind == "MAP":
        names = ["key", "value"]
    elif kind == "UNION":
        names = [f"v{i}" for i in range(len(subs))]
    return list(zip(names, subs))


def schema_changes(files, types):
    tree, out = trees(types), set()

    def compare(a, i, b, j, path, file_id):
        old, new = dict(named_children(a, i)), dict(named_children(b, j))
        name = lambda n: ".".join([*path, n])
        gone = {n: (o, a[x][0]) for o, (n, x) in enumerate(named_children(a, i)) if n not in new}
        come = {n: (o, b[x][0]) for o, (n, x) in enumerate(named_children(b, j)) if n not in old}
        for n, v in come.items():
            twin = [m for m, w in gone.items() if w == v] if a[i][0] == "STRUCT" else []
            if twin:
                out.add((file_id, "renamed", name(n)))
                del gone[twin[0]]
                compare(a, old[twin[0]], b, new[n], [*path, n], file_id)
            else:
                out.add((file_id, "added", name(n)))
        out.update((file_id, "removed", name(n)) for n in gone)
        for n in old.keys() & new.keys():
            if a[old[n]][0] != b[new[n]][0]:
                out.add((file_id, "retyped", name(n)))
            else:
                compare(a, old[n], b, new[n], [*path, n], file_id)

    for feed in by_feed(files)[1].values():
        before = None
        for f in feed:
            t = tree.get(f["file_id"])
            if t is None:
                continue
            if before is not None and before[0][0] == t[0][0]:
                compare(before, 0, t, 0, [], f["file_id"])
            before = t
    return out


def children(types, nested):
    tree, out, seen = trees(types), [], set()
    for r in nested:
        if r["row_id"] in seen or r["row_id"] is None:
            continue
        seen.add(r["row_id"])
        t = tree.get(r["file_id"])
        try:
            value = json.loads(r["payload"])
        except (ValueError, TypeError):
            continue
        if not t:
            continue

        def walk(x, at, path, parent, element=False, t=t, row=r["row_id"]):
            kind = t[at][0]
            if isinstance(x, str) and kind in ("STRUCT", "LIST", "MAP", "UNION"):
                try:
                    x = json.loads(x)
                except ValueError:
                    x = [x] if kind == "LIST" else None
            if x is None:
                return
            subs = t[at][1]
            if kind in ("STRUCT", "UNION"):
                if path != "$":
                    if not element:
                        out.append((row, parent, path))
                    parent = path
                if kind == "STRUCT":
                    for n, s in zip(t[at][2], subs):
                        walk(x.get(n), s, f"{path}.{n}", parent)
                elif 0 <= x["tag"] < len(subs):
                    walk(x["value"], subs[x["tag"]], path + ".value", parent)
            elif kind in ("LIST", "MAP"):
                for i, y in enumerate(x if isinstance(x, list) else [x]):
                    here = f"{path}[{i}]"
                    out.append((row, parent, here))
                    if kind == "LIST":
                        walk(y, subs[0], here, here, True)
                    else:
                        walk(y["key"], subs[0], here + ".key", here)
                        walk(y["value"], subs[1], here + ".value", here)

        walk(value, 0, "$", "$")
    return out


def issues(records, files, stats):
    once = {}
    for r in records:
        once[r["record_id"]] = r
    loads = defaultdict(list)
    for r in once.values():
        loads[r["file_id"]].append(r)
    stated = {(x["file_id"], x["column_name"]): x for x in stats}
    out = set()
    for feed in by_feed(files)[1].values():
        before = None
        for f in feed:
            if f["file_layout"] != "flat":
                continue
            own = loads.get(f["file_id"], [])
            for c in COLUMNS:
                v = [r[c] for r in own if r[c] is not None]
                add = lambda issue, c=c, f=f: out.add((f["file_id"], c, issue))
                x = stated.get((f["file_id"], c))
                if x and x["number_of_values"] is not None and x["number_of_values"] != len(v):
                    add("count")
                if x and x["has_null"] is not None and x["has_null"] != (len(v) < len(own)):
                    add("flag")
                limits = {"c_byte": (0, 255), "c_double": (-1e6, 1e6), "c_date": (dt.date(1900, 1, 1), dt.date(2099, 12, 31))}.get(c)
                if limits and any(not limits[0] <= y <= limits[1] for y in v):
                    add("range")
                if c == "c_varchar" and any(not re.fullmatch("[A-Z]{3}-[0-9]{5}", y) for y in v):
                    add("pattern")
                if c != "c_bool" and len(v) >= 30 and len(set(v)) == 1:
                    add("distinct")
                if before and len(own) >= 40 and len(before) >= 40 and abs((1 - len(v) / len(own)) - sum(r[c] is None for r in before) / len(before)) > 0.3:
                    add("nulls")
                if before and c in ("c_int", "c_double"):
                    w = [r[c] for r in before if r[c] is not None]
                    if len(v) >= 40 and len(w) >= 40 and max(median(v), median(w)) > 3 * min(median(v), median(w)):
                        add("shift")
            if own:
                before = own
    return out


def joined_files(files, stripes):
    once, feeds = by_feed(files)
    st = defaultdict(dict)
    for x in stripes:
        st[x["file_id"]][x["stripe_no"]] = x
    firsts = set()
    for feed in feeds.values():
        seen = set()
        for f in feed:
            if f["body_digest"] not in seen or f["body_digest"] is None:
                firsts.add(f["file_id"])
            seen.add(f["body_digest"])
    small = []
    for file_id, mine in st.items():
        if file_id not in once:
            continue
        order, total, n = sorted(mine), 0, 0
        for k, no in enumerate(order):
            x = mine[no]
            size = x["data_length"]
            if size is None:
                end = mine[order[k + 1]]["stripe_offset"] if k + 1 < len(order) else once[file_id]["content_length"]
                size = end - x["stripe_offset"] - x["index_length"] - x["footer_length"]
            total, n = total + size, n + x["si_number_of_rows"]
        if n >= 1 and total < 65536 and file_id in firsts:
            small.append(file_id)
    days = Counter((once[f]["feed_id"], once[f]["written_at"].date()) for f in small)
    return {f for f in small if days[once[f]["feed_id"], once[f]["written_at"].date()] >= 2}


def zone(text):
    key = (text or "").strip().upper().replace(" ", "_")
    if key in ("", "Z"):
        return dt.timezone.utc
    if m := re.fullmatch(r"(?:UTC|GMT)?([+-])(\d\d):?(\d\d)?", key):
        minutes = int(m[2]) * 60 + int(m[3] or 0)
        return dt.timezone(dt.timedelta(minutes=minutes if m[1] == "+" else -minutes))
    return ZoneInfo(ZONES[key])


def utc_us(wall, tz):
    moment = wall - dt.datetime(1970, 1, 1) - wall.replace(tzinfo=tz, fold=0).utcoffset()
    return (moment.days * 86400 + moment.seconds) * 1_000_000 + moment.microseconds


def read_moment(text, tz, order):
    t = text.strip()
    m = re.fullmatch(r"(\d+)(?:\.(\d+))?", t)
    if m and len(m[1]) != 14:
        n, whole, rest = len(m[1]), m[1], (m[2] or "")
        shift = 6 if n <= 11 else 3 if n <= 14 else 0 if n <= 17 else -3
        return int(whole + (rest + "000000")[:shift]) if shift >= 0 else int(whole[:-3])
    z = tz
    if m := re.search(r"\s*\[(.+)\]$", t) or re.search(r"\s+([A-Za-z]+(?:/[A-Za-z_]+)+)$", t):
        z, t = zone(m[1]), t[: m.start()]
    elif m := re.search(r"\s*(UTC|GMT)$", t) or re.search(r"(?<=\d)([zZ])$", t):
        z, t = dt.timezone.utc, t[: m.start()]
    elif (m := re.search(r"(?<=\d)([+-]\d\d(?::?\d\d)?)$", t)) and ":" in t[: m.start()]:
        z, t = zone(m[1]), t[: m.start()]
    half = None
    if m := re.search(r"\s*(AM|PM|am|pm)$", t):
        half, t = m[1].lower(), t[: m.start()]
    clock = r"(\d{1,2}):(\d\d):(\d\d)(?:[.,](\d+))?"
    try:
        if m := re.fullmatch(r"(\d{4})[-./](\d\d?)[-./](\d\d?)[Tt ]" + clock, t) or re.fullmatch(r"(\d{4})(\d\d)(\d\d)T?(\d\d)(\d\d)(\d\d)(?:[.,](\d+))?", t):
            y, mo, d, h, mi, s, fr = m.groups()
        elif m := re.fullmatch(r"(\d{4})-(\d{3})[Tt ]" + clock, t):
            y, n, h, mi, s, fr = m.groups()
            day = dt.date(int(y), 1, 1) + dt.timedelta(days=int(n) - 1)
            if day.year != int(y):
                return None
            mo, d = day.month, day.day
        elif m := re.fullmatch(r"(\d\d?)/(\d\d?)/(\d{4})[Tt ]" + clock, t):
            a, b, y, h, mi, s, fr = m.groups()
            mo, d = (a, b) if order == "mdy" else (b, a)
        elif m := re.fullmatch(r"([A-Za-z]{3,9}) (\d\d?), (\d{4}) " + clock, t):
            mo, d, y, h, mi, s, fr = m.groups()
            mo = MONTHS[mo[:3].lower()]
        elif m := re.fullmatch(r"(\d\d?)-([A-Za-z]{3})-(\d{4}) " + clock, t):
            d, mo, y, h, mi, s, fr = m.groups()
            mo = MONTHS[mo.lower()]
        else:
            return None
        h = int(h)
        if half:
            if not 1 <= h <= 12:
                return None
            h = h % 12 + (12 if half == "pm" else 0)
        return utc_us(dt.datetime(int(y), int(mo), int(d), h, int(mi), int(s), int(((fr or "") + "000000")[:6])), z)
    except (ValueError, KeyError):
        return None


def instants(records, stripes, files):
    zones = {(x["file_id"], x["stripe_no"]): x["writer_timezone"] for x in stripes}
    order = {f["file_id"]: {m["item_name"]: m["item_value"] for m in f["user_metadata"] or []}.get("date.order") for f in files}
    out = {}
    for r in records:
        tz = zone(zones.get((r["file_id"], r["stripe_no"])))
        if r["c_ts"] is not None:
            v = utc_us(dt.datetime(2015, 1, 1) + dt.timedelta(seconds=r["c_ts"]["seconds"], microseconds=r["c_ts"]["nanos"] // 1000), tz)
        else:
            v = read_moment(r["c_ts_text"], tz, order.get(r["file_id"])) if r["c_ts_text"] is not None else None
        if v is not None:
            out[r["record_id"]] = v
    return out
