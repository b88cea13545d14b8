"""SQL for DuckDB with the results of the registered queries, over the same whole tables."""

from __future__ import annotations


def show(x: str) -> str:
    """A double from 0.1 up to ten million, or a whole number of hundredths below 0.1."""
    return f"(case when {x} is null then 'null' when {x} = 0 then '0.0' when abs({x}) < 0.1 then cast(cast(round({x} * 100) as bigint) as varchar) || '.0e-2' else cast({x} as varchar) end)"


def quoted(x: str) -> str:
    body = f"replace({x}, '\\', '\\\\')"
    for c in range(1, 32):
        if c not in (9, 10, 13):
            body = f"replace({body}, chr({c}), '\\u{c:04x}')"
    for c, e in ((34, '\\"'), (10, "\\n"), (13, "\\r"), (9, "\\t")):
        body = f"replace({body}, chr({c}), '{e}')"
    return f"coalesce('\"' || {body} || '\"', 'null')"


def plain(x: str) -> str:
    return f"coalesce(cast({x} as varchar), 'null')"


def fields(**named: str) -> str:
    return "'{' || " + " || ', ' || ".join(f"'\"{k}\": ' || {v}" for k, v in named.items()) + " || '}'"


def nano(ts: str) -> str:
    return f"coalesce('\"' || strftime({ts}, '%Y-%m-%dT%H:%M:%S.') || lpad(cast((epoch_us({ts}) % 1000000) * 1000 as varchar), 9, '0') || '\"', 'null')"


CHUNKED = "(select *, row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 as ordinal, (row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1) // 10000 as chunk from lineitem)"
EVENTS = "(select *, row_number() over (order by event_id) - 1 as ordinal, (row_number() over (order by event_id) - 1) // 1000 as chunk from events)"
RECORDS = "(select distinct on (record_id) * from row_records order by record_id)"
FILES = """(select file_id, feed_id, dataset, file_layout, written_at, body_digest, content_length, number_of_rows,
  lower(trim(list_filter(user_metadata, lambda x: x.item_name = 'date.order')[1].item_value)) as date_order
  from (select *, row_number() over (partition by file_id order by registered_at) as k from orc_files) where k = 1)"""
DECIMAL = """case when digits = '' then '0.0' when point between 0 and 7 then
    case when point = 0 then '0.' || digits when point >= length(digits) then rpad(digits, cast(point as int), '0') || '.0' else substr(digits, 1, point) || '.' || substr(digits, point + 1) end
  else substr(digits, 1, 1) || '.' || (case when length(digits) > 1 then substr(digits, 2) else '0' end) || 'e' || (point - 1) end"""

SQL: dict[str, str] = {
    "scan_rows": "select * from lineitem",
    "scan_pushed": "select l_orderkey, l_quantity from lineitem where l_quantity >= 45",
    "scan_continued": "select o_orderstatus, count(*) as n, 6 as fields from orders group by 1",
    "scan_attempted": "select 'good' as name, true as ok, count(*) as n from orders union all select 'missing', false, null",
    "scan_stripes": "select o_orderstatus, count(*) as n, cast(sum(o_orderkey) as bigint) as keys, count(*) as places from orders group by 1",
    "meta_footers": "select 'zstd' as compression, cast(262144 as bigint) as block_size, count(*) as n, count(*) as stripe_rows, 12 as types, cast(0 as bigint) as errors from lineitem",
    "meta_statistics": """select 0 as column_id, count(*) as number_of_values, false as has_null from documents union all select 1, count(doc_id), count(doc_id) < count(*) from documents
        union all select 2, count(lang), count(lang) < count(*) from documents union all select 3, count(family_id), count(family_id) < count(*) from documents
        union all select 4, count(n_claims), count(n_claims) < count(*) from documents""",
    "meta_stripes": """select column_id, encoding, n, true as zone, true as streams from (select count(*) as n from lineitem),
        (values (0, 'DIRECT'), (1, 'DIRECT_V2'), (2, 'DIRECT_V2'), (3, 'DIRECT'), (4, 'DICTIONARY_V2'), (5, 'DIRECT_V2')) t(column_id, encoding)""",
    "meta_typed": """select 1 as column_id, count(*) as n, cast(min(l_orderkey) as double) as least, cast(max(l_orderkey) as double) as most, cast(sum(l_orderkey) as double) as total, null as first_text from lineitem
        union all select 2, count(*), null, null, cast(sum(strlen(l_returnflag)) as double), min(l_returnflag) from lineitem union all select 3, count(*), min(l_quantity), max(l_quantity), sum(l_quantity), null from lineitem""",
    "meta_items": "select 'org.apache.spark.version' as item_name, true as four",
    "meta_checked": "select 'good' as name, true as ok, count(*) as n, 'zstd' as codec from orders union all select 'bad', false, null, null",
    "scan_streams": "select 1 as column_id, l_orderkey as value, count(*) as n from lineitem group by 2 union all select 2, l_partkey, count(*) from lineitem group by 2 union all select 3, cast(l_linenumber as bigint), count(*) from lineitem group by 2",
    "sink_attempted": "select * from (values ('good', true), ('doubled', false), ('codec', false), ('schema', false)) t(name, ok)",
    "proj_composites": "select vec_id as id, cast(len(embedding) as int) as size, cast(null as timestamp) as moment, null as bytes from embeddings union all select event_id, null, ts, hex(encode(event_type)) from events",
    "enc_coded_varint": f"""with z as (select chunk, ordinal, 2 * l_partkey as z from {CHUNKED}), h as (select chunk, string_agg(case when z < 128 then printf('%02X', z) when z < 16384 then printf('%02X%02X', z & 127 | 128, z >> 7)
        when z < 2097152 then printf('%02X%02X%02X', z & 127 | 128, (z >> 7) & 127 | 128, z >> 14) else printf('%02X%02X%02X%02X', z & 127 | 128, (z >> 7) & 127 | 128, (z >> 14) & 127 | 128, z >> 21) end, '' order by ordinal) as h from z group by 1)
        select chunk, cast(length(h) // 2 as bigint) as bytes, md5(h) as digest from h""",
    "enc_bytes_float": f"select ordinal, cast(l_quantity as float) as value from {CHUNKED}",
    "stream_observed": "select count(*) as written, count(*) as n, count(*) filter (event_type = 'click') as clicks, cast(sum(user_id) as bigint) as total from events",
    "meta_types": "select * from (values (0, '', 'struct'), (1, 'vec_id', 'bigint'), (2, 'embedding', 'array'), (3, 'embedding.item', 'float'), (4, 'label', 'int')) t(column_id, path, kind)",
    "meta_registered": f"select file_id, feed_id, number_of_rows, date_order from {FILES}",
    "sink_rows_per_file": "select cast(least(1000, n - 1000 * i) as bigint) as number_of_rows, count(*) as files from (select count(*) as n from orders), (select unnest(range(0, 100000)) as i) where 1000 * i < n group by 1",
    "sink_empty": "select * from (values ('n_nationkey', 'int'), ('n_name', 'string'), ('n_regionkey', 'int')) t(path, kind)",
    **{f"sink_reencode_{c}": "select * from orders" for c in ("none", "snappy", "zlib", "zstd")},
    "sink_roundtrip": "select * from events",
    "sink_json": f"select {fields(s_suppkey=plain('s_suppkey'), s_name=quoted('s_name'), s_nationkey=plain('s_nationkey'))} as value from supplier",
    "proj_scalars": "select record_id, c_bool, c_byte, c_short, c_int, c_long, c_float, c_double, c_dec, date_diff('day', date '1970-01-01', c_date)::int as c_date, c_str, c_varchar, c_char from row_records",
    "proj_struct": "select record_id, c_ts.seconds as seconds, c_ts.nanos as nanos, c_ts.seconds as _0, c_ts.nanos as _1 from row_records",
    "proj_union": "select event_id, cast(event_id % 2 as int) as tag, case when event_id % 2 = 0 then value end as number, case when event_id % 2 = 1 then event_type end as word from events",
    "proj_variant_rows": "select event_id, event_type as word from events where event_id % 2 = 1",
    "proj_map": "select n_regionkey, cast(row_number() over (partition by n_regionkey order by n_name) - 1 as int) as pos, n_name, n_nationkey from nation",
    "proj_present": "select doc_id, lang from documents where lang is not null",
    "proj_consumer": "select l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem where l_discount > 0.05 group by 1",
    "col_presence": "select doc_id, (row_number() over (order by doc_id) - 1) // 1000 as chunk, lang from documents",
    "col_presence_counts": "select chunk, count(*) as n, count(lang) as present, count(lang) < count(*) as partial from (select lang, (row_number() over (order by doc_id) - 1) // 1000 as chunk from documents) group by 1",
    "col_lists": "select vec_id, cast(i - 1 as int) as pos, cast(embedding[i] as double) as value from embeddings, unnest(range(1, len(embedding) + 1)) t(i)",
    "col_list_lengths": "select vec_id, cast(len(embedding) as int) as length from embeddings",
    "col_list_slices": """select o_custkey, cast(row_number() over (partition by o_custkey order by o_orderkey) - 1 as int) as ordinal, cast(n as int) as n, cast(total as int) as total
        from orders join (select l_orderkey, count(*) as n, sum(l_linenumber) as total from lineitem group by 1) on o_orderkey = l_orderkey""",
    "col_maps": "select n_regionkey, cast(row_number() over (partition by n_regionkey order by n_nationkey) - 1 as int) as pos, case when n_nationkey % 5 = 0 then null else substr(n_name, 1, 1) end as map_key, n_nationkey as map_value from nation",
    "col_unions": "select event_id, cast(event_id % 2 as int) as tag, case when event_id % 2 = 0 then value end as v0, case when event_id % 2 = 1 then event_type end as v1 from events",
    "col_decimals": "select record_id, cast(c_dec * 10000 as bigint) as unscaled, 4 as scale, c_dec as back from row_records where c_dec is not null",
    "col_timestamps": "select record_id, c_ts.seconds as seconds, c_ts.nanos as nanos from row_records where c_ts is not null",
    "col_zip": "select o as ordinal, s_suppkey, n_nationkey from (select row_number() over (order by s_suppkey) - 1 as o, s_suppkey from supplier) join (select row_number() over (order by n_nationkey) - 1 as o, n_nationkey from nation) using (o)",
    "col_chunks": f"select chunk, count(*) as n, sum(l_quantity) as quantity, min(l_orderkey) as first_key from {CHUNKED} group by 1",
    "col_transpose": "select cast(i - 1 as int) as pos, row_number() over (partition by i order by vec_id) - 1 as k, cast(embedding[i] as double) as value from embeddings, unnest(range(1, len(embedding) + 1)) t(i)",
    "col_transpose_jagged": """with v as (select l_orderkey, l_partkey, row_number() over (partition by l_orderkey order by l_partkey) - 1 as pos from lineitem)
        select cast(pos as int) as pos, row_number() over (partition by pos order by l_orderkey) - 1 as k, l_partkey as value from v""",
    "col_segments_back": f"select ordinal, coalesce(event_type, '') as event_type from {EVENTS}",
    "col_typed_rows": """select case when event_id % 7 <> 0 then event_id end as event_id, case when event_id % 7 <> 0 then user_id end as user_id,
        case when event_id % 7 = 0 then '{"event_id": ' || event_id || ', "user_id": "x"}' end as text from events""",
    "col_segments": "select doc_id, cast(coalesce(sum(strlen(text)) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as \"offset\", strlen(text) as length from documents",
    "col_heads": "select vec_id, cast(embedding[1] as double) as head, case when len(embedding) > 0 then cast(len(embedding) - 1 as int) end as rest from embeddings",
    "set_append": "select o_orderkey as key, o_totalprice as amount from orders union all select c_custkey, c_acctbal from customer",
    "set_concat": "select o_orderkey, o_orderpriority from orders",
    "set_length": "select count(*) as n from lineitem",
    "set_empty": "select cast(0 as bigint) as n",
    "chunk_resize": """with h as materialized (select hex(encode(string_agg(text, '' order by doc_id))) as h from documents), l as materialized (select cast(sum(strlen(text)) as bigint) as l from documents)
        select i as chunk, cast(least(65536, l - 65536 * i) as bigint) as n, md5(substr(h, 131072 * i + 1, 131072)) as digest from l, h, unnest(range(0, (select (l + 65535) // 65536 from l))) t(i)""",
    "chunk_gather": "select 'all' as what, 25 as n, string_agg(n_name, '|' order by n_nationkey) as names from nation union all select 'ten', 10, string_agg(n_name, '|' order by n_nationkey) from nation where n_nationkey < 10",
    "chunk_total": "select cast(sum(strlen(text)) as bigint) as n from documents",
    "chunk_fold": f"select chunk, cast(sum(length(cast(step as varchar)) + 1) as bigint) as n from (select chunk, event_id - coalesce(nullif(lag(event_id) over (partition by chunk order by event_id), 0), event_id) as step from {EVENTS}) group by 1",
    "chunk_map": "select event_id, upper(event_type) as upper_type from events",
    "fn_dates": "select record_id, date_diff('day', date '1970-01-01', c_date)::int as day, year(c_date)::int as year, month(c_date)::int as month, day(c_date)::int as day_of_month, date_diff('day', date '1970-01-01', c_date) as back from row_records where c_date is not null",
    "fn_timestamps": """select record_id, date '2015-01-01' + cast(floor(c_ts.seconds / 86400.0) as int) as date, (c_ts.seconds - 86400 * cast(floor(c_ts.seconds / 86400.0) as bigint)) * 1000000000 + c_ts.nanos as nano_of_day,
        c_ts.seconds as seconds, c_ts.nanos as nanos from row_records where c_ts is not null""",
    "fn_moments": "select event_id, cast(floor(epoch_us(ts) / 1000000.0) as bigint) - 1420070400 as seconds, (epoch_us(ts) - 1000000 * cast(floor(epoch_us(ts) / 1000000.0) as bigint)) * 1000 as nanos from events",
    "fn_nanoseconds": """select record_id, n as nanos, cast(case when n = 0 then 0 when z >= 2 then cast(substr(s, 1, length(s) - z) as bigint) * 8 + z - 1 else n * 8 end as bigint) as code, n as back
        from (select record_id, c_ts.nanos as n, cast(c_ts.nanos as varchar) as s, least(length(cast(c_ts.nanos as varchar)) - length(rtrim(cast(c_ts.nanos as varchar), '0')), 8) as z from row_records where c_ts is not null)""",
    "fn_zigzag": """select record_id, case when c_long >= 0 then c_long * 2 else -2 * c_long - 1 end as code, c_long as back, cast(case when c_int >= 0 then cast(c_int as bigint) * 2 else -2 * cast(c_int as bigint) - 1 end as bigint) as small,
        cast(c_int as bigint) as plain, cast(case when c_long >= 0 then c_long * 2 else -2 * c_long - 1 end as decimal(38, 0)) as wide from row_records where c_long is not null""",
    "fn_widths": "select cast(i as int) as code, cast(case when i < 24 then i + 1 when i < 28 then 2 * i - 22 else 8 * i - 184 end as int) as width from unnest(range(0, 32)) t(i)",
    "fn_words24": "select o_orderkey, upper(printf('%02x%02x%02x', (o_orderkey % 16777216) & 255, ((o_orderkey % 16777216) >> 8) & 255, (o_orderkey % 16777216) >> 16)) as bytes, o_orderkey % 16777216 as back from orders",
    "fn_big_endian": "select o_orderkey, o_orderkey as plain, case when o_orderkey % 2 = 0 then o_orderkey // 2 else -(o_orderkey // 2) - 1 end as zigzagged, o_orderkey as magnitude from orders",
    "fn_bytes": "select record_id, cast(c_byte & 255 as int) as byte from row_records where c_byte is not null",
    "json_lineitem": "select "
    + fields(
        l_orderkey=plain("l_orderkey"), l_partkey=plain("l_partkey"), l_suppkey=plain("l_suppkey"), l_linenumber=plain("l_linenumber"), l_quantity=show("l_quantity"), l_extendedprice=show("l_extendedprice"),
        l_discount=show("l_discount"), l_tax=show("l_tax"), l_returnflag=quoted("l_returnflag"), l_linestatus=quoted("l_linestatus"), l_shipdate=nano("l_shipdate"),
    )
    + " as value from lineitem",
    "json_documents": f"select {fields(doc_id=plain('doc_id'), text=quoted('text'), lang=quoted('lang'), n_claims=plain('n_claims'))} as value from documents",
    "json_records": f"""with a as (select *, cast(abs(c_dec) as varchar) as s from row_records),
        b as (select *, split_part(s, '.', 1) as whole, split_part(s, '.', 2) as frac from a),
        c as (select *, rtrim(ltrim(whole || frac, '0'), '0') as digits, length(whole) - (length(whole || frac) - length(ltrim(whole || frac, '0'))) as point from b)
        select {fields(
            record_id=plain('record_id'), c_bool=plain('c_bool'), c_byte=plain('c_byte & 255'),
            c_date="coalesce('\"' || strftime(c_date, '%Y-%m-%d') || '\"', 'null')",
            c_dec=f"case when c_dec is null then 'null' else (case when c_dec < 0 then '-' else '' end) || {DECIMAL} end",
            c_ts="coalesce('\"' || strftime(timestamp '2015-01-01' + to_seconds(c_ts.seconds), '%Y-%m-%dT%H:%M:%S.') || lpad(cast(c_ts.nanos as varchar), 9, '0') || '\"', 'null')",
            c_bin="coalesce('[' || array_to_string(list_transform(range(1, strlen(c_char) + 1), lambda i: cast(cast('0x' || substr(hex(encode(c_char)), 2 * i - 1, 2) as int) as varchar)), ', ') || ']', 'null')",
        )} as value from c""",
    "json_nested": """select '{"n_regionkey": ' || n_regionkey || ', "nations": [' || string_agg('{"n_nationkey": ' || n_nationkey || ', "n_name": "' || n_name || '"}', ', ' order by n_nationkey) || '], "m": ['
        || string_agg('{"key": "' || n_name || '", "value": ' || n_nationkey || '}', ', ' order by n_nationkey) || '], "u": {"tag": ' || n_regionkey % 2 || ', "value": ' || case when n_regionkey % 2 = 0 then cast(n_regionkey as varchar) else '"odd"' end || '}}' as value
        from nation group by n_regionkey""",
    "json_roots": "select '\"' || r_name || '\"' as value from region",
    "enc_dictionary_choice": f"select chunk, count(props) as present, count(distinct props) as \"distinct\", count(distinct props) < 0.5 * count(props) as dictionary from {EVENTS} group by 1",
    "enc_dictionary": f"""with e as {EVENTS}, f as (select chunk, event_type, min(ordinal) as first from e where event_type is not null group by all),
        g as (select chunk, event_type, row_number() over (partition by chunk order by first) - 1 as id from f) select ordinal, id, e.event_type from e left join g using (chunk, event_type)""",
    "enc_tags": f"select chunk, cast(event_id % 2 as int) as tag, count(*) as n from {EVENTS} group by all",
    "enc_equal_runs": f"""with m as (select chunk, ordinal, l_returnflag as value, row_number() over (partition by chunk order by ordinal) - row_number() over (partition by chunk, l_returnflag order by ordinal) as island from {CHUNKED})
        select chunk, min(ordinal) as start, count(*) as length, value from m group by chunk, value, island""",
    "enc_step_runs": f"""with s as (select chunk, ordinal, l_linenumber as v, l_linenumber - lag(l_linenumber) over (partition by chunk order by ordinal) as step from {CHUNKED}),
        m as (select *, row_number() over (partition by chunk order by ordinal) - row_number() over (partition by chunk, step order by ordinal) as island from s where step is not null)
        select chunk, min(ordinal) - 1 as start, count(*) + 1 as length, cast(arg_min(v - step, ordinal) as bigint) as base, cast(step as bigint) as step from m group by chunk, step, island""",
    "enc_expand": "select o_orderkey, i, o_orderkey + i * (o_custkey % 5 - 2) as value from orders, unnest(range(0, o_orderkey % 7 + 3)) t(i)",
    "enc_repeats": "select o_orderkey, cast(o_orderkey % 12 as int) as n, o_custkey * (o_orderkey % 12) as total from orders where o_orderkey % 12 between 3 and 10",
    "enc_bits": f"select chunk, (ordinal % 1000) // 8 as byte_no, cast(sum(case when event_type = 'click' then 1 << cast(7 - (ordinal % 1000) % 8 as int) else 0 end) as int) as byte from {EVENTS} group by 1, 2",
    "enc_bits_back": f"select chunk, count(*) filter (event_type = 'click') as n, cast(sum(case when event_type = 'click' then ordinal % 1000 else 0 end) as bigint) as places from {EVENTS} group by 1",
    "enc_deltas": f"select chunk, ordinal, first_value(l_partkey) over w as base, coalesce(l_partkey - lag(l_partkey) over w, 0) as delta, l_partkey as value from {CHUNKED} window w as (partition by chunk order by ordinal)",
    "enc_varint_lengths": "select cast(case when l_partkey < 64 then 1 when l_partkey < 8192 then 2 when l_partkey < 1048576 then 3 else 4 end as int) as bytes, count(*) as n from lineitem group by 1",
    "enc_bytes_varint": f"select ordinal, l_partkey as value from {CHUNKED}",
    "enc_bytes_runs": f"select ordinal, cast(l_linenumber as bigint) as value from {CHUNKED}",
    "enc_bytes_bytes": f"select ordinal, cast(l_linenumber as bigint) as value from {CHUNKED}",
    "enc_bytes_double": f"select ordinal, l_extendedprice as value from {CHUNKED}",
    "udf_stripes": "select event_id, value * 2.0 as doubled from events",
    "stream_files": "select event_id, user_id, event_type from events",
    "p4_joined": f"""with f as {FILES}, s as (select file_id, stripe_no, max(stripe_offset) as o, max(index_length) as i, max(data_length) as d, max(footer_length) as l, max(si_number_of_rows) as n from stripes group by all),
        e as (select s.*, coalesce(d, coalesce(lead(o) over (partition by s.file_id order by stripe_no), content_length) - o - i - l) as size from s join f using (file_id)),
        z as (select file_id, sum(size) as size, sum(n) as n from e group by 1 having count(size) = count(*)),
        k as (select f.*, row_number() over (partition by feed_id, body_digest order by written_at, file_id) as turn from f),
        small as (select file_id, feed_id, cast(written_at as date) as day, written_at, size from k join z using (file_id) where (turn = 1 or body_digest is null) and n >= 1 and size < 65536),
        laid as (select *, count(*) over (partition by feed_id, day) as c, (sum(size) over (partition by feed_id, day order by written_at, file_id) - size) // 134217728 as container from small),
        r as (select file_id, count(*) as n from (select distinct file_id, record_id as id from row_records union all select distinct file_id, row_id from nested_rows) group by 1)
        select feed_id || '/' || day || '/' || cast(container as bigint) as container_id, count(*) as files, cast(coalesce(sum(r.n), 0) as bigint) as records, true as intact from laid left join r using (file_id) where c >= 2 group by 1""",
    "p4_found": f"""with f as {FILES}, s as (select file_id, stripe_no, max(stripe_offset) as o, max(index_length) as i, max(data_length) as d, max(footer_length) as l, max(si_number_of_rows) as n from stripes group by all),
        e as (select s.*, coalesce(d, coalesce(lead(o) over (partition by s.file_id order by stripe_no), content_length) - o - i - l) as size from s join f using (file_id)),
        z as (select file_id, sum(size) as size, sum(n) as n from e group by 1 having count(size) = count(*)),
        k as (select f.*, row_number() over (partition by feed_id, body_digest order by written_at, file_id) as turn from f),
        small as (select file_id, feed_id, cast(written_at as date) as day from k join z using (file_id) where (turn = 1 or body_digest is null) and n >= 1 and size < 65536)
        select file_id from (select file_id, count(*) over (partition by feed_id, day) as c from small) where c >= 2""",
}


def _profile_sql() -> tuple[str, str]:
    """(the exact profile of each column of each load, the columns out of order)."""
    names = "c_bool c_byte c_short c_int c_long c_float c_double c_dec c_date c_str c_varchar c_char".split()
    bad = {"c_byte": "c_byte not between 0 and 255", "c_double": "not (c_double between -1e6 and 1e6)", "c_date": "c_date not between date '1900-01-01' and date '2099-12-31'"}
    each = " union all ".join(
        f"""select file_id, '{c}' as column_name, cast(count(*) as bigint) as rows, count({c}) as n, count(distinct {c}) as "distinct", count(*) filter ({bad.get(c, 'false')}) as out_of_range,
        count(*) filter ({"not regexp_full_match(c_varchar, '[A-Z]{3}-[0-9]{5}')" if c == 'c_varchar' else 'false'}) as off_pattern,
        entropy({c}) as entropy, {f'quantile_cont(cast({c} as double), 0.5)' if c in ('c_int', 'c_double') else 'cast(null as double)'} as median from r group by 1"""
        for c in names
    )
    base = f"with r as {RECORDS}, m as ({each})"
    whole = f"{base} select file_id, column_name, rows, n, \"distinct\", out_of_range, off_pattern, round(case when n > 0 then entropy end, 6) as entropy, round(median, 6) as median from m"
    issues = f"""{base}, f as (select * from {FILES} where file_layout = 'flat'),
        o as (select f.file_id, lag(f.file_id) over (partition by feed_id order by written_at) as before from f join (select distinct file_id from r) using (file_id)),
        s as (select file_id, column_name, max(number_of_values) as sn, max(has_null) as sh from column_stats group by all),
        g as (select f.file_id, c.column_name from f, (select unnest({names!r}) as column_name) c),
        x as (select g.file_id, g.column_name, coalesce(a.rows, 0) as rows, coalesce(a.n, 0) as n, a."distinct" as di, a.out_of_range as oor, a.off_pattern as op, a.median as me, b.rows as rows0, b.n as n0, b.median as me0, sn, sh
            from g left join m a using (file_id, column_name) left join o using (file_id) left join m b on b.file_id = o.before and b.column_name = g.column_name left join s on s.file_id = g.file_id and s.column_name = g.column_name)
        select file_id, column_name, 'count' as issue from x where sn is not null and sn <> n union all select file_id, column_name, 'flag' from x where sh is not null and sh <> (rows > n)
        union all select file_id, column_name, 'range' from x where oor > 0 union all select file_id, column_name, 'pattern' from x where op > 0
        union all select file_id, column_name, 'distinct' from x where column_name <> 'c_bool' and n >= 30 and di = 1
        union all select file_id, column_name, 'nulls' from x where rows >= 40 and rows0 >= 40 and abs((rows - n) / rows - (rows0 - n0) / rows0) > 0.3
        union all select file_id, column_name, 'shift' from x where n >= 40 and n0 >= 40 and greatest(me, me0) > 3 * least(me, me0)"""
    return whole, issues


SQL["p3_profile"], SQL["p3_found"] = _profile_sql()


def _drift_sql() -> tuple[str, str]:
    """(every change between a file's type tree and the one before, the lifespans of fields)."""
    trees = f"""f as (select * from {FILES}),
        d as (select distinct file_id, type_id, upper(trim(kind)) as kind, coalesce(subtypes, []) as subs, coalesce(field_names, []) as fields from file_types),
        t as (select *, case kind when 'STRUCT' then fields when 'LIST' then ['item'] when 'MAP' then ['key', 'value'] else list_transform(range(0, len(subs)), lambda i: 'v' || i) end as names from d),
        c as (select file_id, type_id as parent, kind as parent_kind, i as ordinal, subs[i] as sub, names[i] as name from t, unnest(range(1, len(subs) + 1)) u(i)),
        ch as (select c.*, t.kind from c join t on t.file_id = c.file_id and t.type_id = c.sub),
        p as (select file_id, string_agg(type_id || kind || subs::varchar || fields::varchar, '|' order by type_id) as print from d group by 1),
        o as (select file_id, feed_id, written_at, print, lag(print) over w as print_before, lag(file_id) over w as before from f join p using (file_id) window w as (partition by feed_id order by written_at, file_id))"""
    changes = f"""with recursive {trees},
        m(file_id, before, a, b, path) as (
            select o.file_id, o.before, 0, 0, '' from o join t x on x.file_id = o.before and x.type_id = 0 join t y on y.file_id = o.file_id and y.type_id = 0 where x.kind = y.kind and o.print <> o.print_before
            union all select m.file_id, m.before, x.sub, y.sub, m.path || '.' || y.name
            from m join ch x on x.file_id = m.before and x.parent = m.a join ch y on y.file_id = m.file_id and y.parent = m.b
                join t s on s.file_id = m.before and s.type_id = m.a join t z on z.file_id = m.file_id and z.type_id = m.b
            where x.kind = y.kind and (x.name = y.name or (y.parent_kind = 'STRUCT' and x.ordinal = y.ordinal and not list_contains(s.names, y.name) and not list_contains(z.names, x.name)))),
        old as (select m.*, x.name, x.kind, x.ordinal, s.kind as parent_kind, z.names as others from m join ch x on x.file_id = m.before and x.parent = m.a join t s on s.file_id = m.before and s.type_id = m.a join t z on z.file_id = m.file_id and z.type_id = m.b),
        new as (select m.*, x.name, x.kind, x.ordinal, s.kind as parent_kind, z.names as others from m join ch x on x.file_id = m.file_id and x.parent = m.b join t s on s.file_id = m.file_id and s.type_id = m.b join t z on z.file_id = m.before and z.type_id = m.a),
        gone as (select * from old where not list_contains(others, name)), fresh as (select * from new where not list_contains(others, name)),
        r as (select y.file_id, y.path, y.a, y.b, x.name as was, y.name from gone x join fresh y on x.file_id = y.file_id and x.a = y.a and x.b = y.b and x.ordinal = y.ordinal and x.kind = y.kind and y.parent_kind = 'STRUCT')
        select file_id, change_kind, substr(path || '.' || name, 2) as field_path from (
            select file_id, 'renamed' as change_kind, path, name from r
            union all select file_id, 'removed', path, name from gone g where not exists (select 1 from r where r.file_id = g.file_id and r.a = g.a and r.b = g.b and r.was = g.name)
            union all select file_id, 'added', path, name from fresh g where not exists (select 1 from r where r.file_id = g.file_id and r.a = g.a and r.b = g.b and r.name = g.name)
            union all select n.file_id, 'retyped', n.path, n.name from new n join old x on x.file_id = n.file_id and x.a = n.a and x.b = n.b and x.name = n.name and x.kind <> n.kind)"""
    spans = f"""with recursive {trees},
        v as (select file_id, feed_id, sum(case when print is distinct from print_before then 1 else 0 end) over (partition by feed_id order by written_at, file_id) as version, print is distinct from print_before as changed from o),
        w as (select * from v where changed),
        n(feed_id, file_id, version, type_id, kind, path) as (select feed_id, file_id, version, 0, cast('' as varchar), cast('' as varchar) from w
            union all select n.feed_id, n.file_id, n.version, ch.sub, ch.kind, n.path || chr(1) || ch.name from n join ch on ch.file_id = n.file_id and ch.parent = n.type_id),
        i as (select *, version - row_number() over (partition by feed_id, path, kind order by version) as island from n where path <> '')
        select feed_id, replace(substr(path, 2), chr(1), '.') as field_path, kind, cast(min(version) as bigint) as first_version, cast(max(version) as bigint) as last_version, arg_min(file_id, version) as first_file_id
        from i group by feed_id, path, kind, island"""
    return changes, spans


SQL["p1_found"], SQL["p1_lifespans"] = _drift_sql()


def _sizes_sql() -> str:
    """Bytes of each stripe's line numbers by codec, runs of up to 130 being taken greedily from the left."""
    return f"""with recursive c as (select chunk, row_number() over (partition by chunk order by ordinal) - 1 as i, l_linenumber as v from {CHUNKED}), n as (select chunk, count(*) as n from c group by 1),
        s as (select *, lead(v) over (partition by chunk order by i) - v as step from c),
        -- stretches of equal steps, each from its first value to its last, which the next one shares
        g as (select *, i - row_number() over (partition by chunk, step order by i) as island from s where step is not null),
        e as (select chunk, min(i) as a, max(i) + 1 as b, row_number() over (partition by chunk order by min(i)) as j from g group by chunk, step, island),
        r(chunk, j, a, b, taken) as (select chunk, j, a, b, b - a + 1 >= 3 from e where j = 1
            union all select e.chunk, e.j, case when r.taken then e.a + 1 else e.a end, e.b, e.b - (case when r.taken then e.a + 1 else e.a end) + 1 >= 3 from r join e on e.chunk = r.chunk and e.j = r.j + 1),
        q as (select chunk, v, i, i - row_number() over (partition by chunk, v order by i) as island from c),
        x as (select 'runs' as codec, chunk, a, b, 3 as cost from r where taken union all select 'bytes', chunk, min(i), max(i), 2 from q group by chunk, v, island having count(*) >= 3),
        y as (select codec, chunk, a, b, cost, a - coalesce(lag(b) over (partition by codec, chunk order by a), -1) - 1 as literals from x
            union all select k.codec, n.chunk, n.n, n.n, 0, n.n - coalesce(max(x.b), -1) - 1 from n cross join (values ('runs'), ('bytes')) k(codec) left join x on x.codec = k.codec and x.chunk = n.chunk group by k.codec, n.chunk, n.n)
        select y.chunk, codec, n.n, cast(sum(cost + literals + (literals + 127) // 128) as bigint) as bytes from y join n using (chunk) group by all union all select chunk, 'varint', n, n from n"""


SQL["enc_bytes_sizes"] = _sizes_sql()


def _instants_sql() -> str:
    """One UTC instant per record. A wall-clock time is read with the offset of the day before; where that gives another time on the clock, with that of
    the day after; where neither does, it never occurred, and the former holds."""
    clock, half = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?", r"\s*(am|pm|a\.m\.|p\.m\.)"
    zone = r"\s*(z|utc|gmt|(?:utc|gmt)?[+-]\d{2}(?::?\d{2})?|\[[^\]\[]+\]|[a-z]+(?:/[a-z0-9_+-]+)+)?$"
    month = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
    # the day's pattern, and which of its groups are year, month, day
    days = {"ymd": (r"^(\d{4})[-./](\d{1,2})[-./](\d{1,2})[t ]\s*", (1, 2, 3)), "slash": (r"^(\d{1,2})/(\d{1,2})/(\d{4})[t ]\s*", (3, 1, 2)), "mdy": (rf"^(?:[a-z]{{3,9}},\s*)?{month}\s+(\d{{1,2}}),?\s+(\d{{4}}),?\s+", (3, 1, 2)), "dmy": (rf"^(?:[a-z]{{3}},\s*)?(\d{{1,2}})[- ]{month}[- ](\d{{4}}),?\s+", (3, 2, 1))}
    forms = []
    for name, (day, at) in days.items():
        for h in ("", half):
            forms.append((name, day + clock + h + zone, [*at, 4, 5, 6, 7, 8 if h else 0, 9 if h else 8]))
    forms.append(("ymd", r"^(\d{4})(\d{2})(\d{2})[t ]?(\d{2})(\d{2})(\d{2})(?:[.,](\d+))?" + zone, [1, 2, 3, 4, 5, 6, 7, 0, 8]))
    forms.append(("ordinal", r"^(\d{4})-(\d{3})[t ]" + clock + zone, [1, 2, 0, 3, 4, 5, 6, 0, 7]))
    part = lambda pattern, g: f"regexp_extract(t, '{pattern}', {g})" if g else "''"
    match = " ".join(f"when regexp_matches(t, '{p}') then ['{n}', {', '.join(part(p, g) for g in gs)}]" for n, p, gs in forms)
    key = lambda x: f"upper(replace(trim(regexp_replace({x}, '[\\[\\]\\s]+', ' ', 'g')), ' ', '_'))"
    number, fixed = r"^([+-]?)(\d{1,20})(?:[.](\d+))?$", r"^(?:UTC|GMT|UT)?([+-])(\d{1,2})(?::?(\d{2}))?$"
    offset = lambda x: f"""case when {x} in ('Z', 'UTC', 'GMT', 'UT') then 0 when regexp_matches({x}, '{fixed}') then (case when regexp_extract({x}, '{fixed}', 1) = '-' then -1 else 1 end)
        * (cast(regexp_extract({x}, '{fixed}', 2) as bigint) * 60 + coalesce(try_cast(regexp_extract({x}, '{fixed}', 3) as bigint), 0)) * 60000000 end"""  # noqa: E731
    return f"""with f as (select * from {FILES}), r as (select record_id, file_id, stripe_no, c_ts, lower(trim(regexp_replace(c_ts_text, '^\\s+|\\s+$', '', 'g'))) as t from {RECORDS}),
        w as (select file_id, stripe_no, coalesce(nullif({key('coalesce(max(writer_timezone), chr(32))')}, ''), 'UTC') as writer from stripes group by all),
        a as (select r.*, date_order, coalesce(writer, 'UTC') as writer, case {match} end as p from r left join f using (file_id) left join w using (file_id, stripe_no)),
        b as (select *, p[1] as form, try_cast(p[2] as int) as y, case p[1] when 'ordinal' then 1 when 'slash' then case date_order when 'mdy' then try_cast(p[3] as int) when 'dmy' then try_cast(p[4] as int) end
                else coalesce(try_cast(p[3] as int), list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], p[3])) end as m,
            case p[1] when 'ordinal' then 1 when 'slash' then case date_order when 'mdy' then try_cast(p[4] as int) when 'dmy' then try_cast(p[3] as int) end else try_cast(p[4] as int) end as d,
            case when p[1] = 'ordinal' then cast(p[3] as int) end as yd, try_cast(p[5] as int) as h, try_cast(p[6] as int) as i, coalesce(try_cast(p[7] as int), 0) as s, rpad(substr(p[8], 1, 6), 6, '0') as us, p[9] as half, {key('p[10]')} as own from a),
        c as (select *, case when y >= 1 and m between 1 and 12 and d between 1 and 31 then try_cast(lpad(y::varchar, 4, '0') || '-' || lpad(m::varchar, 2, '0') || '-' || lpad(d::varchar, 2, '0') as date) end as day,
            case when half <> '' then h between 1 and 12 else h between 0 and 23 end and i < 60 and s < 60 as clock,
            case when half like 'a%' then h % 12 when half like 'p%' then h % 12 + 12 else h end as hour, regexp_extract(t, '{number}', 1) as sign, regexp_extract(t, '{number}', 2) as digits, regexp_extract(t, '{number}', 3) as tail from b),
        e as (select *, case when length(digits) <= 11 then 6 when length(digits) <= 14 then 3 when length(digits) <= 17 then 0 else -3 end as shift from c),
        g as (select *, case when form is null and digits <> '' then case when shift >= 0 then digits || rpad(substr(tail, 1, shift), shift, '0') else substr(digits, 1, length(digits) - 3) end end as whole,
            case when shift >= 0 then substr(tail, shift + 1) else right(digits, 3) || tail end as rest from e),
        k as (select record_id, c_ts is not null as stamped, whole, case when sign = '-' then -cast(whole as hugeint) - (case when regexp_matches(rest, '[1-9]') then 1 else 0 end) else cast(whole as hugeint) end as epoch,
            case when c_ts is not null or coalesce(own, '') = '' then writer else own end as zone,
            case when c_ts is not null then (c_ts.seconds + 1420070400) * 1000000 + coalesce(c_ts.nanos, 0) // 1000
                when clock and day is not null and (yd is null or yd between 1 and dayofyear(make_date(y, 12, 31))) then (epoch_us(day::timestamp) + (coalesce(yd, 1) - 1) * 86400000000) + ((hour * 60 + i) * 60 + s)::bigint * 1000000 + us::bigint end as wall from g),
        n as (select name, upper(name) as zone from pg_timezone_names()), z as (select k.*, {offset('k.zone')} as off, (select min(name) from n where n.zone = k.zone) as name from k),
        o as (select *, epoch_us(timezone(name, make_timestamptz(wall - 86400000000))) - (wall - 86400000000) as o1, epoch_us(timezone(name, make_timestamptz(wall + 86400000000))) - (wall + 86400000000) as o2 from z where off is null and name is not null and wall is not null),
        x as (select record_id, case when epoch_us(timezone(name, make_timestamptz(wall - o1))) = wall or epoch_us(timezone(name, make_timestamptz(wall - o2))) <> wall then wall - o1 else wall - o2 end as utc_us from o where whole is null or stamped)
        select * from x union all select record_id, wall - off from z where (whole is null or stamped) and off is not null and wall is not null
        union all select record_id, cast(epoch as bigint) from z where whole is not null and not stamped"""


SQL["p5_found"] = _instants_sql()


def _children_sql() -> str:
    """Every child row of the nested payloads with its parent, by walking down values and types together."""
    text = "json_type(v) = 'VARCHAR'"
    inner = "json_valid(v->>'$') and json_type(cast(v->>'$' as json)) in ('OBJECT', 'ARRAY')"
    # a composite value as it was written, then in the shape that its kind asks for
    meant = f"case when {text} and {inner} then cast(v->>'$' as json) when {text} and kind = 'LIST' and trim(v->>'$') <> 'null' then json_array(v) when {text} or json_type(v) = 'NULL' then null else v end"
    shaped = """case kind when 'LIST' then case when json_type(w) = 'ARRAY' then w when w is not null then json_array(w) end
        when 'MAP' then case when json_type(w) = 'ARRAY' then w when json_type(w) = 'OBJECT' and len(json_keys(w)) > 0 and list_has_all(['key', 'value'], json_keys(w)) then json_array(w)
            when json_type(w) = 'OBJECT' then to_json(list_transform(json_keys(w), lambda k: {'key': k, 'value': w->k})) end
        when 'STRUCT' then case when json_type(w) = 'OBJECT' then w when json_type(w) = 'ARRAY' and json_array_length(w) = 1 and json_type(w->0) = 'OBJECT' then w->0 end
        when 'UNION' then case when json_type(w) = 'OBJECT' then w when json_type(w) = 'ARRAY' and json_array_length(w) = 1 and json_type(w->0) = 'OBJECT' then w->0 end end"""
    child = lambda sub, v, path, parent, element: f"{{'sub': {sub}, 'v': {v}, 'path': {path}, 'parent': {parent}, 'element': {element}}}"
    here = "n.path || '[' || i || ']'"
    places = "range(0, cast(json_array_length(n.v) as bigint))"
    below = f"""case n.kind when 'STRUCT' then list_transform(range(1, len(n.subs) + 1), lambda i: {child('n.subs[i]', 'n.v->(n.fields[i])', "n.path || '.' || n.fields[i]", 'n.path', 'false')})
        when 'UNION' then case when try_cast(n.v->>'tag' as int) between 0 and len(n.subs) - 1 then [{child("n.subs[try_cast(n.v->>'tag' as int) + 1]", "n.v->'value'", "n.path || '.value'", 'n.path', 'false')}] end
        when 'LIST' then list_transform({places}, lambda i: {child('n.subs[1]', 'n.v->(i)', here, here, 'true')})
        when 'MAP' then list_concat(list_transform({places}, lambda i: {child('n.subs[1]', "(n.v->(i))->'key'", here + " || '.key'", here, 'false')}), list_transform({places}, lambda i: {child('n.subs[2]', "(n.v->(i))->'value'", here + " || '.value'", here, 'false')})) end"""
    down = lambda source: f"select row_id, file_id, kind, subs, fields, {shaped} as v, path, parent, element from (select *, {meant} as w from ({source}))"
    return f"""with recursive t as (select distinct file_id, type_id, upper(trim(kind)) as kind, coalesce(subtypes, []) as subs, coalesce(field_names, []) as fields from file_types),
        r as (select distinct on (row_id) row_id, file_id, regexp_replace(payload, '[\\x00-\\x1f]', ' ', 'g') as payload from nested_rows where row_id is not null order by row_id, ingested_at nulls last),
        b as (select row_id, file_id, cast(payload as json) as v from r where json_valid(payload)),
        n(row_id, file_id, kind, subs, fields, v, path, parent, element) as (
            {down("select row_id, b.file_id, kind, subs, fields, v, '$' as path, '$' as parent, true as element from b join t on t.file_id = b.file_id and type_id = 0")}
            union all {down(f"select row_id, c.file_id, kind, subs, fields, x.v as v, x.path as path, x.parent as parent, x.element as element from (select n.row_id, n.file_id, unnest({below}) as x from n where n.v is not null) c join t on t.file_id = c.file_id and t.type_id = x.sub where kind in ('STRUCT', 'LIST', 'MAP', 'UNION')")})
        select row_id, parent as parent_path, path as child_path from n where v is not null and kind in ('STRUCT', 'UNION') and not element
        union all select row_id, parent, path || '[' || unnest({places.replace('n.v', 'v')}) || ']' from n where v is not null and kind in ('LIST', 'MAP')"""


SQL["p2_found"] = _children_sql()
