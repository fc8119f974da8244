"""The same results as SQL for the checking engine, written apart from the operators."""

import re

from .queries import AT, FROM, PAGE_SIZE, SET, TO
from .views import TEXTS, check_text


def _norm(c):
    return f"lower(trim(coalesce({c}, '')))"


def _blank(c):
    return f"(trim(coalesce({c}, '')) = '')"


def _number_key(s, n):
    return f"{{'kind': 'number', 'set': {_norm(s)}, 'value': {_norm(n)}}}"


def _name_key(s, n):
    return f"{{'kind': 'name', 'set': {_norm(s)}, 'value': {_norm(n)}}}"


_KEY_PARTS = (
    "match_key.kind as key_kind, match_key['set'] as key_set, match_key['value'] as key_value"
)


def _price(foil, usd="usd", usd_foil="usd_foil"):
    return f"try_cast(case when {foil} then {usd_foil} else {usd} end as decimal(12,2))"


_DATE = (
    "case when regexp_full_match({0}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')"
    " then try_cast({0} as date) end"
)
_HOLDING = (
    "id, card_number, card_name, set_code, set_name_raw, foil, card_type, language, quantity,"
    " price, comment, location"
)
_HOLDING_OUT = _HOLDING.replace("price", "cast(price as double) as price")
_SET_COLUMNS = (
    "set_code, set_name, release_date, set_type, card_count, printed_size, block_code,"
    " block_name, icon_svg_uri"
)
_GRID = "sheet, row_no, a, b, c, d, e, f, g, h, i, j, k, a_num, f_num, g_num"
_CELL_TEXT = (
    "case when a_num = floor(a_num) then cast(cast(a_num as bigint) as varchar)"
    " when a_num is not null then cast(a_num as varchar) else a end"
)
_QUANTITY = (
    "greatest(coalesce(case when f_num is not null then cast(trunc(f_num) as int)"
    " when regexp_full_match(trim(f), '[+-]?[0-9]+') then try_cast(trim(f) as int) end, 1), 1)"
)
_TITLED = (
    "row_no = 3 and lower(trim(a)) = 'number (optional)' and lower(trim(b)) = 'card'"
    " and lower(trim(c)) = 'set' and lower(trim(d)) = 'foil'"
)
_DATA_ROW = f"(row_no >= 4 and not ({_blank('b')} and {_blank('c')}))"
_IDENTITY = ("card_name", "set_code", "card_number", "foil", "language")

_CTES = {
    **{name: check_text(name) for name in TEXTS},
    "sets": f"""
        select code as set_code, name as set_name, {_DATE.format("released_at")} as release_date,
          set_type, card_count, printed_size, block_code, block as block_name, icon_svg_uri
        from sets_feed""",
    "holdings": f"select {_HOLDING} from snapshots",
    "totals": """
        select snapshot_ts, cast(sum(coalesce(price, 0) * quantity) as double) as total_value
        from snapshots group by snapshot_ts""",
    "pair": """
        select min(snapshot_ts) as old_ts, max(snapshot_ts) as new_ts
        from (select distinct snapshot_ts from snapshots order by 1 desc limit 2)
        having count(*) = 2""",
    "old_side": f"""
        select * from (
          select s.*, row_number() over (
            partition by {", ".join(_IDENTITY)} order by id desc) as rn
          from snapshots s, pair where snapshot_ts = old_ts) where rn = 1""",
    "changes": f"""
        select n.id, {", ".join("n." + c for c in _IDENTITY if c != "card_number")},
          n.set_name_raw, n.source_card_id,
          coalesce(o.price, 0) as price_old, coalesce(n.price, 0) as price_new,
          coalesce(n.price, 0) - coalesce(o.price, 0) as price_diff
        from snapshots n join pair on n.snapshot_ts = pair.new_ts join old_side o
          on {" and ".join(f"n.{c} is not distinct from o.{c}" for c in _IDENTITY)}
        where coalesce(n.price, 0) <> coalesce(o.price, 0)""",
    "feed_keys": f"""
        select feed_seq, {_number_key('"set"', "collector_number")} as match_key from cards_feed
        where "set" is not null and collector_number is not null
        union
        select feed_seq, {_name_key('"set"', "name")} from cards_feed
        where "set" is not null and name is not null
        union
        select feed_seq, {_name_key('"set"', "face")} from (
          select feed_seq, "set", unnest(string_split(name, ' // ')) as face from cards_feed
          where "set" is not null and contains(name, ' // ')) where trim(face) <> ''""",
    "first_keys": """
        select match_key, c.* from (
          select match_key, min(feed_seq) as first_seq from feed_keys group by match_key)
        join cards_feed c on first_seq = c.feed_seq""",
    "good_sheets": f"select distinct sheet from grid where {_TITLED}",
    "normalized": f"""
        select sheet, row_no, {_CELL_TEXT} as number, a as number_text, a_num as number_num,
          f_num as quantity_num, g_num as price_num, b as card, c as set_text, d as foil_text,
          e as type_text, f as quantity_text, g as price_text, h as total_text, i as comment,
          j as language, k as location,
          coalesce(lower(trim(d)) in ('sim', 's', 'yes', 'y', 'foil', 'true'), false) as foil,
          {_QUANTITY} as quantity,
          coalesce(starts_with(lower(trim(i)), '*conferir sempre manualmente'), false) as manual,
          {_norm("c")} as set_key, concat(sheet, '!', cast(row_no as varchar)) as row_ref
        from grid where sheet in (select sheet from good_sheets) and {_DATA_ROW}""",
    "set_names": f"""
        select {_norm("set_name")} as set_key, max(set_code) as set_code
        from sets where set_name is not null group by 1""",
    "keyed": f"""
        select n.*, s.set_code,
          case when s.set_code is null or manual then null
            when not {_blank("number")} then {_number_key("s.set_code", "number")}
            when not {_blank("card")} then {_name_key("s.set_code", "card")} end as match_key
        from normalized n left join set_names s on n.set_key = s.set_key""",
    "resolved": f"""
        select k.*,
          case when manual then type_text else type_line end as card_type,
          case when manual then coalesce(cast(price_num as decimal(12,2)),
              try_cast(trim(price_text) as decimal(12,2)))
            else {_price("foil")} end as price,
          case when f.match_key is not null and {_blank("number")} then collector_number
            else number end as card_number,
          case when manual then null when set_code is null then 'set_not_found'
            when k.match_key is null then 'no_name_or_number'
            when f.match_key is null then 'card_not_found' end as reason
        from keyed k left join first_keys f on k.match_key = f.match_key""",
    "errors": f"""
        select row_ref, reason as error from resolved
        where reason in ('set_not_found', 'no_name_or_number')
        union all
        select row_ref, 'card_name_blank' from resolved where {_blank("card")}""",
    "stored": f"""
        select case when {_blank("card_number")} then null else card_number end as card_number,
          card as card_name, set_code, set_text as set_name_raw, foil, card_type,
          case when {_blank("language")} then null else language end as language, quantity,
          price, comment, location, sheet, row_no
        from resolved where not {_blank("card")}""",
    "filled": f"""
        select {_GRID} from grid
        where not (sheet in (select sheet from good_sheets) and {_DATA_ROW})
        union all
        select sheet, row_no, number_text, card, set_text, foil_text,
          case when manual then type_text else coalesce(card_type, type_text) end, quantity_text,
          case when manual then price_text else coalesce(cast(price as varchar), price_text) end,
          total_text, comment, language, location, number_num, quantity_num,
          case when manual then price_num else coalesce(cast(price as double), price_num) end
        from resolved""",
    "report": """
        select sheet, row_no, coalesce(number, '') as number, coalesce(card, '') as card,
          coalesce(set_text, '') as "set", coalesce(foil_text, '') as foil, reason
        from resolved where reason is not null""",
    "identifiers": f"""
        select sheet, row_no, case when {_blank("number")} then card end as name,
          set_code as "set", case when not {_blank("number")} then number end as collector_number,
          match_key
        from keyed where match_key is not null""",
    "clean_all": """
        select req_seq, trim(set_code) as set_code, trim(set_name) as set_name,
          try_cast(nullif(trim(release_date), '') as date) as release_date,
          nullif(trim(set_type), '') as set_type,
          try_cast(trim(card_count) as int) as card_count,
          try_cast(trim(printed_size) as int) as printed_size,
          nullif(trim(block_code), '') as block_code, nullif(trim(block_name), '') as block_name
        from set_requests""",
    "clean": "select * from clean_all where set_code <> '' and set_name <> ''",
    "set_winners": """
        select set_code, min(req_seq) as req_seq from clean
        where set_code not in (select set_code from sets) group by set_code""",
    "checked_adds": f"""
        select *, case when {_blank("card_name")} then 'card_name_blank'
            when {_blank("set_code")} then 'set_code_blank'
            when {_blank("language")} then 'language_blank'
            when quantity <= 0 then 'quantity_not_positive' end as reason
        from add_requests""",
    "checked_patches": f"""
        select *, case when {_blank("language")} then 'language_blank'
            when quantity <= 0 then 'quantity_not_positive' end as reason
        from patches""",
    "folded": f"""
        select id,
          arg_max(card_name, req_seq) filter (where not {_blank("card_name")}) as n_name,
          arg_max(set_code, req_seq) filter (where not {_blank("set_code")}) as n_set,
          arg_max(foil, req_seq) as n_foil, arg_max(language, req_seq) as n_language,
          arg_max(quantity, req_seq) as n_quantity,
          arg_max(trim(card_type), req_seq) as n_type,
          arg_max(price, req_seq) as n_price,
          arg_max(trim(comment), req_seq) as n_comment,
          arg_max(trim(location), req_seq) as n_location
        from checked_patches where reason is null group by id""",
    "refreshed": f"""
        select h.*, k.id is not null as asked, f.match_key is not null as hit, f.*
        from (select *, case when {_blank("set_code")} then null
              when not {_blank("card_number")} then {_number_key("set_code", "card_number")}
              when not {_blank("card_name")} then {_name_key("set_code", "card_name")}
              end as row_key from holdings) h
          left join (select distinct id from keys) k on h.id = k.id
          left join first_keys f on h.row_key = f.match_key""",
    "known_sets": "select set_code, min(set_name) as set_name from sets group by set_code",
}


def _new(old, patched):
    return f"case when {patched} = '' then null else coalesce({patched}, {old}) end as {old}"


def _tagged(*parts, by="part"):
    """Union by name of (tag, select) parts; absent columns become null."""
    selects = [f"select *, '{tag}' as {by} from ({text})" for tag, text in parts]
    return " union all by name ".join(selects)


def _mover_list(side, limit=None):
    sign, way = (">", "desc") if side == "gainer" else ("<", "asc")
    cut = f"limit {limit}" if limit else ""
    return f"""
        select *, row_number() over (order by price_diff {way}, card_name, id) as place
        from changes where price_diff {sign} 0 order by place {cut}"""


def _mover_out(side, limit=None, place=True):
    return f"""
        select id, card_name, set_code, set_name_raw, foil, language, source_card_id,
          cast(price_old as double) as price_old, cast(price_new as double) as price_new,
          cast(price_diff as double) as price_diff {", place" if place else ""}
        from ({_mover_list(side, limit)})"""


def _export_out(side):
    return f"""
        select place as row_no, card_name,
          coalesce(nullif(set_name_raw, ''), set_code) as set_name, set_code,
          case when foil then 'Sim' else 'Não' end as foil, coalesce(language, '') as language,
          cast(price_old as double) as price_old, cast(price_new as double) as price_new,
          cast(price_diff as double) as price_diff
        from ({_mover_list(side)})"""


def _page(start):
    return f"""
        select id, cast(price as double) as price, card_name, place - first_place as place,
          total, page_count, first_place // {PAGE_SIZE} + 1 as page
        from (select *, cast({start} as bigint) as first_place from (
          select id, price, card_name,
            row_number() over (order by price desc nulls first, id) as place,
            count(*) over () as total,
            cast(ceil(count(*) over () / {PAGE_SIZE}.0) as bigint) as page_count
          from holdings))
        where place > first_place and place <= first_place + {PAGE_SIZE}"""


def _snapshot_of(ts, base):
    columns = _HOLDING_OUT.replace("id, ", f"{base} + row_number() over (order by id) as id, ", 1)
    return f"""
        select {columns}, id as source_card_id, timestamp '{ts}' as snapshot_ts from holdings"""


def _both_lists(limit):
    return _tagged(
        ("gainer", _mover_out("gainer", limit)),
        ("loser", _mover_out("loser", limit)),
        ("compared", "select old_ts, new_ts from pair"),
    )


def _metrics(failed=0):
    return f"""
        select count(*) as total, count(*) as processed,
          count(*) filter (where not {_blank("card")}) as persisted,
          count(*) filter (where reason is not null) as unresolved,
          (select count(*) from errors) + {failed} as errors
        from resolved"""


def _refreshed_out(columns, asked):
    return f"""
        select {columns} from (
          select id,
            case when hit and {asked} and {_blank("card_number")}
              then coalesce(collector_number, card_number) else card_number end as card_number,
            card_name, set_code, set_name_raw, foil,
            case when hit and {asked} then coalesce(type_line, card_type) else card_type end
              as card_type,
            language, quantity,
            cast(case when hit and {asked} then coalesce({_price("foil")}, price) else price end
              as double) as price, comment, location
          from refreshed)"""


def _refresh_failed(asked):
    return f"""
        select id, case when row_key is null then 'insufficient_data' else 'card_not_found' end
          as reason
        from refreshed where {asked} and not hit"""


def _missing(key, table, asked="keys"):
    return f"""
        select distinct {key} from {asked}
        where {key} not in (select {key} from {table})"""


def _priced(by, key):
    blank = f"({_blank(by)} or {_blank('set_code')})"
    return _tagged(
        ("priced", f"""
            select h.id, h.{by}, h.set_code, h.foil, cast({_price("h.foil")} as double) as price
            from holdings h left join first_keys f on {key} = f.match_key where not {blank}"""),
        ("rejected", f"select id, {by}, set_code, foil from holdings where {blank}"),
    )


def _manifest(face):
    suffix = f"_face{face}" if face else ""
    png = "back_png" if face else "coalesce(png, front_png)"
    safe = "trim(regexp_replace({0}, '[/\\\\:*?\"<>|]', '_', 'g'))"
    name = safe.format(f"concat(h.card_name, '{suffix}')")
    return f"""
        select h.id,
          case when h.set_code is null or h.card_number is null then null
            else concat({safe.format("coalesce(s.set_name, h.set_code)")}, ' - ', h.set_code, '/',
              h.card_number, '-', {name}, '.png') end as object_key,
          {png} as png_url,
          case when front_png is not null and back_png is not null then 2 else 1 end
            as face_count,
          coalesce(layout, 'normal') as layout,
          case when h.set_code is null then 'no_set_code'
            when h.card_number is null then 'no_collector_number'
            when f.match_key is null then 'card_not_found'
            when {png} is null then 'no_picture' else 'ok' end as status
        from holdings h left join known_sets s on h.set_code = s.set_code
          left join first_keys f on h.card_number is not null
            and {_number_key("h.set_code", "h.card_number")} = f.match_key"""


_ALL_SNAPSHOTS = _HOLDING_OUT + ", source_card_id, snapshot_ts"
_IN_RANGE = f"snapshot_ts >= timestamp '{FROM}:00' and snapshot_ts <= timestamp '{TO}'"
_FEED_OUT = (
    "name as feed_name, \"set\" as feed_set, collector_number as feed_number,"
    " type_line as feed_type, usd as feed_usd, usd_foil as feed_usd_foil"
)
_STORED_OUT = """
    select card_number, card_name, set_code, set_name_raw, foil, card_type, language, quantity,
      cast(price as double) as price, comment, location, sheet, row_no from stored"""
_FILTERED_SETS = """
    select * from sets where contains(lower(set_name), 'supplier#00')
      and contains(lower(set_type), 'core') and contains(lower(block_name), 'nation_1')"""

_AFTER = "lag(name) over (partition by feed_seq // 75 order by feed_seq) as after"
_CUT_SHORT = """
    select concat('{"object":"list","data":[{"name":"', n_name) as text from nation"""

_CHECKS = {
    "total_value_by_snapshot": f"""
        select *, row_number() over (order by snapshot_ts) as place
        from totals where {_IN_RANGE}""",
    "list_snapshots": """
        select snapshot_ts, row_number() over (order by snapshot_ts desc) as place
        from (select distinct snapshot_ts from snapshots)""",
    "count_snapshot_rows": f"""
        select count(*) as rows from snapshots where snapshot_ts = timestamp '{AT}'""",
    "count_by_source": """
        select a.source_card_id, count(s.id) as rows
        from (select distinct feed_seq * 2 as source_card_id from cards_feed) a
          left join snapshots s on a.source_card_id = s.source_card_id group by 1""",
    "latest_two": f"""
        select snapshot_ts, row_number() over (order by snapshot_ts) as place from (
          select distinct snapshot_ts from snapshots where snapshot_ts <= timestamp '{TO}'
          order by 1 desc limit 2)""",
    "range_filter": f"select {_ALL_SNAPSHOTS} from snapshots where {_IN_RANGE}",
    "snapshot_rows": f"""
        select {_ALL_SNAPSHOTS}, row_number() over (order by card_name, id) as place
        from snapshots where snapshot_ts = timestamp '{AT}'""",
    "snapshot_projection": f"""
        select {_HOLDING_OUT.replace("set_name_raw, ", "")}, source_card_id, snapshot_ts
        from snapshots""",
    "series_summary": """
        select count(*) as count, arg_min(total_value, snapshot_ts) as first,
          arg_max(total_value, snapshot_ts) as last,
          cast(cast(arg_max(total_value, snapshot_ts) as decimal(33,2))
            - cast(arg_min(total_value, snapshot_ts) as decimal(33,2)) as double) as delta,
          min(total_value) as min, max(total_value) as max
        from totals having count(*) > 0""",
    "price_movers_gainers": _mover_out("gainer", 100),
    "price_movers_losers": _mover_out("loser", 100),
    "price_movers_cut": _both_lists(10),
    "price_movers_unlimited": _both_lists(None),
    "price_movers_of_one": _tagged(
        ("gainer", f"select * from ({_mover_out('gainer')}) where false"),
        ("compared", "select cast(null as timestamp) as old_ts, cast(null as timestamp) as new_ts"),
    ),
    "export_projection": _export_out("gainer"),
    "export_movers": _tagged(
        ("gainer", _export_out("gainer")), ("loser", _export_out("loser")), by="side"
    ),
    "create_snapshot": f"""
        select *, snapshot_ts as ts
        from ({_snapshot_of("1998-04-01 00:00:01", "(select max(id) from snapshots)")})""",
    "append_snapshot": f"""
        {_snapshot_of(AT, "0")}
        union all {_snapshot_of(f"{FROM}:00", "(select count(*) from holdings)")}
        union all {_snapshot_of(AT[:-2] + "01", "2 * (select count(*) from holdings)")}""",
    "append_snapshot_again": f"""
        select snapshot_ts, count(*) as rows, count(*) as ids,
          generation * count(*) + 1 as first_id, (generation + 1) * count(*) as last_id,
          cast(sum(id % 1000003) as bigint) as sources,
          cast(sum(coalesce(price, 0) * quantity) as double) as total_value
        from holdings, (values (timestamp '{AT}', 0), (timestamp '{FROM}:00', 1),
          (timestamp '{AT[:-2]}01', 2)) as taken(snapshot_ts, generation)
        group by snapshot_ts, generation""",
    "refresh_totals": """
        select snapshot_ts, cast(sum(coalesce(price, 0) * quantity) as double) as total_value
        from snapshots group by snapshot_ts""",
    "price_movers_bucketed": _tagged(
        ("gainer", _mover_out("gainer", 10)), ("loser", _mover_out("loser", 10))
    ),
    "stored_snapshot_rows": _tagged(
        ("rows", f"""
            select * exclude (set_name_raw), row_number() over (order by card_name, id) as place
            from ({_snapshot_of(AT, "0")})"""),
        ("totals", f"""
            select timestamp '{FROM}:00' as snapshot_ts,
              cast(sum(coalesce(price, 0) * quantity) as double) as total_value from holdings"""),
    ),
    "delete_snapshot": _tagged(
        ("kept", f"""
            select {_ALL_SNAPSHOTS} from snapshots
            where snapshot_ts <> timestamp '{AT}'"""),
        ("removed", f"""
            select count(*) > 0 as removed from snapshots where snapshot_ts = timestamp '{AT}'"""),
    ),
    "project_sets": f"""
        select code as set_code, name as set_name, {_DATE.format("released_at")} as release_date,
          set_type, card_count, printed_size, block_code, block as block_name, icon_svg_uri,
          feed_seq
        from sets_feed""",
    "scan_sets": "select * from sets",
    "get_set": _tagged(
        ("found", "select * from sets where set_code in (select trim(set_code) from set_requests)"),
        ("missing", """
            select distinct trim(set_code) as set_code from set_requests
            where trim(set_code) not in (select set_code from sets)"""),
    ),
    "filter_sets": _FILTERED_SETS,
    "search_sets": """
        select * from sets where contains(lower(set_name), 's1') or contains(lower(set_code), 's1')
    """,
    "upsert_sets": f"""
        with incoming as (
          select *, feed_seq as seq, 0 as again from sets_feed where set_type = 'core'
          union all
          select * replace (concat(name, ' again') as name, null as released_at),
            feed_seq + 1000000000, 1 from sets_feed where block_code <> '3'),
        last as (select * from incoming
          qualify row_number() over (partition by code order by seq desc) = 1)
        select code as set_code, name as set_name, {_DATE.format("released_at")} as release_date,
          set_type, card_count, printed_size, block_code, block as block_name, icon_svg_uri
        from last
        union all
        select * replace (concat('stored ', set_name) as set_name) from sets
        where set_code not in (select code from last)""",
    "clean_set_input": _tagged(
        ("clean", "select * from clean_all where set_code <> '' and set_name <> ''"),
        ("incomplete", "select * from clean_all where set_code = '' or set_name = ''"),
    ),
    "create_set": _tagged(
        ("sets", """
            select * from sets union all by name
            select c.* exclude (req_seq), null as icon_svg_uri
            from clean c join set_winners w on c.set_code = w.set_code and c.req_seq = w.req_seq
        """),
        ("conflicts", """
            select c.* from clean c anti join set_winners w
            on c.set_code = w.set_code and c.req_seq = w.req_seq"""),
    ),
    "update_set": """
        with asked as (select *,
            case when block_name like '%3' then 'other' else set_code end as path_code from clean),
        last as (select * from asked where path_code = set_code
          qualify row_number() over (partition by set_code order by req_seq desc) = 1),
        updated as (
          select s.set_code,
            case when n.set_code is null then s.set_name else n.set_name end as set_name,
            case when n.set_code is null then s.release_date else n.release_date end
              as release_date,
            case when n.set_code is null then s.set_type else n.set_type end as set_type,
            case when n.set_code is null then s.card_count else n.card_count end as card_count,
            case when n.set_code is null then s.printed_size else n.printed_size end
              as printed_size,
            case when n.set_code is null then s.block_code else n.block_code end as block_code,
            case when n.set_code is null then s.block_name else n.block_name end as block_name,
            s.icon_svg_uri
          from sets s left join last n on s.set_code = n.set_code),
        rejected as (
          select *, 'code_mismatch' as reason from asked where path_code <> set_code
          union all
          select *, 'not_found' from asked
          where path_code = set_code and set_code not in (select set_code from sets))
        """
    + _tagged(("sets", "select * from updated"), ("rejected", "select * from rejected")),
    "delete_set": _tagged(
        ("kept", "select * from sets where set_code not in (select set_code from clean)"),
        ("missing", _missing("set_code", "sets", "clean")),
    ),
    "icon_worklist": f"""
        select set_code, concat(set_code, '.svg') as object_key, icon_svg_uri from sets
        where not {_blank("icon_svg_uri")} and set_type <> 'core'""",
    "matching_sheets": "select * from grid where sheet in (select sheet from good_sheets)",
    "data_rows": f"select * from grid where {_DATA_ROW}",
    "normalize_grid": "select * from normalized",
    "resolve_set": "select sheet, row_no, set_code from keyed",
    "build_match_keys": f"select sheet, row_no, set_code, {_KEY_PARTS} from keyed",
    "expand_feed_keys": f"select {_KEY_PARTS}, {_FEED_OUT} from first_keys",
    "enrich": """
        select sheet, row_no, set_code, card_number, card_type, cast(price as double) as price,
          reason from resolved""",
    "enrich_without_feed": _tagged(
        ("metrics", f"""
            select count(*) as total, count(*) as processed,
              count(*) filter (where not {_blank("card")}) as persisted,
              count(*) filter (where not manual) as unresolved,
              (select count(*) from errors) + 2 as errors
            from resolved"""),
        ("errors", """
            select * from errors
            union all select null, 'feed_lookup_failed'
            union all select null, 'set_sync_failed'"""),
    ),
    "unresolved_report": "select *, row_number() over (order by sheet, row_no) as place from report",
    "import_metrics": _metrics(),
    "import_errors": "select * from errors",
    "persist_import": _STORED_OUT,
    "insert_import": f"""
        select {_HOLDING_OUT} from holdings
        union all by name
        select (select max(id) from holdings) + row_number() over (order by sheet, row_no) as id,
          * exclude (sheet, row_no) from ({_STORED_OUT})""",
    "enriched_grid": "select * from filled",
    "import_grid": _tagged(
        ("stored", _STORED_OUT),
        ("unresolved", "select * exclude (foil), foil as foil_text from report"),
        ("errors", "select * from errors"),
        ("metrics", _metrics()),
    ),
    "write_enriched_grid": "select * from filled",
    "write_unresolved": """
        select * replace (case when card <> '' then concat('say "', card, '",', chr(10), 'or not')
          else '' end as card) from report""",
    "scan_holdings": f"select {_HOLDING_OUT} from holdings",
    "holdings_by_set": f"select {_HOLDING_OUT} from holdings where set_code = '{SET}'",
    "get_by_id": _tagged(
        ("found", f"select {_HOLDING_OUT} from holdings where id in (select id from keys)"),
        ("missing", _missing("id", "holdings")),
    ),
    "find_stack": f"""
        select {_HOLDING_OUT} from holdings where set_code = '{SET}' and card_number = '151'
          and not foil and language = 'O'""",
    "filter_holdings": f"""
        select {_HOLDING_OUT} from holdings where contains(lower(card_name), 'ring')
          and contains(lower(language), 'f') and foil""",
    "line_totals": "select id, cast(price * quantity as double) as line_total from holdings",
    "with_set_name": """
        select id, h.set_code, coalesce(set_name, h.set_code) as set_name
        from holdings h left join known_sets s on h.set_code = s.set_code""",
    "sort_grid": """
        select row_number() over (order by
            cast(regexp_extract(location, '[0-9]+') as bigint) desc nulls first, id) as place,
          id, location
        from (select * replace (nullif(location, '') as location) from holdings)""",
    "sort_by_set_name": """
        select id, set_name, row_number() over (order by starts_with(set_name, 's') desc,
          cast(regexp_extract(set_name, '[0-9]+') as bigint) nulls last, id) as place
        from (select id, coalesce(set_name, h.set_code) as set_name
          from holdings h left join known_sets s on h.set_code = s.set_code)""",
    "paginate": _page(2 * PAGE_SIZE),
    "paginate_numbered": _page(2 * PAGE_SIZE),
    "paginate_ranged": _page(2 * PAGE_SIZE),
    "paginate_past_end": _page(f"(page_count - 1) * {PAGE_SIZE}"),
    "exists_key": "select id, id in (select id from holdings) as exists from keys",
    "delete_rows": _tagged(
        ("kept", f"select {_HOLDING_OUT} from holdings where id not in (select id from keys)"),
        ("missing", _missing("id", "holdings")),
    ),
    "validate_add": _tagged(
        ("ok", "select * from checked_adds where reason is null"),
        ("rejected", "select * from checked_adds where reason is not null"),
    ),
    "validate_patch": """
        select id, req_seq, case when reason is null then 'ok' else 'rejected' end as part, reason
        from checked_patches""",
    "add_holding": _tagged(
        ("holdings", f"""
            select {_HOLDING_OUT} from holdings
            union all by name
            select (select max(id) from holdings) + req_seq as id,
              collector_number as card_number, coalesce(f.name, card_name) as card_name,
              coalesce(f."set", set_code) as set_code, foil, type_line as card_type, language,
              quantity
            from checked_adds join first_keys f
              on {_name_key("set_code", "card_name")} = match_key where reason is null"""),
        ("failed", f"""
            select * from checked_adds where reason is not null
            union all
            select * replace ('card_not_found' as reason) from checked_adds
            where reason is null and {_name_key("set_code", "card_name")}
              not in (select match_key from feed_keys)"""),
    ),
    "patch_holdings": _tagged(
        ("holdings", f"""
            select {_HOLDING_OUT} from (
              select h.id, card_number, coalesce(n_name, card_name) as card_name,
                coalesce(n_set, set_code) as set_code, set_name_raw,
                case when p.id is null then foil else n_foil end as foil,
                {_new("card_type", "n_type")},
                case when p.id is null then language else n_language end as language,
                case when p.id is null then quantity else n_quantity end as quantity,
                coalesce(n_price, price) as price, {_new("comment", "n_comment")},
                {_new("location", "n_location")}
              from holdings h left join folded p on h.id = p.id)"""),
        ("rejected", """
            select id, req_seq, reason from checked_patches where reason is not null
            union all
            select id, req_seq, 'row_not_found' from checked_patches
            where reason is null and id not in (select id from holdings)"""),
    ),
    "refresh_prices": _tagged(
        ("holdings", _refreshed_out("*", "true")), ("failed", _refresh_failed("true"))
    ),
    "refresh_chosen_prices": _tagged(
        ("holdings", _refreshed_out("*", "asked")),
        ("failed", f"""
            {_refresh_failed("asked")}
            union all select id, 'row_not_found' from ({_missing("id", "holdings")})"""),
    ),
    "price_by_name": _priced("card_name", _name_key("h.set_code", "h.card_name")),
    "price_by_number": _priced("card_number", _number_key("h.set_code", "h.card_number")),
    "card_lookup": """
        select i.sheet, i.row_no, f.name as card_name, f.collector_number as card_number, f.usd,
          f.layout, case when f.type_line = 'PROMO' then 2 end as faces
        from identifiers i left join first_keys f on i.match_key = f.match_key""",
    "not_found": """
        select * exclude (match_key) from identifiers
        where match_key not in (select match_key from feed_keys)""",
    "plan_lookup_batches": """
        select batch_id, count(*) as identifiers,
          concat('{"identifiers":[', string_agg(one, ',' order by no), ']}') as body
        from (select *, (no - 1) // 75 as batch_id from (
          select row_number() over (order by sheet, row_no) as no,
            case when collector_number is not null
              then concat('{"set":"', "set", '","collector_number":"', collector_number, '"}')
              else concat('{"name":"', name, '","set":"', "set", '"}') end as one
          from identifiers))
        group by batch_id""",
    "image_manifest": _manifest(0),
    "image_manifest_back": _manifest(1),
    "image_manifest_cached": f"""
        with manifest as ({_manifest(0)}),
        held as (select distinct object_key from manifest join holdings using (id) where foil)
        select m.* replace (case when held.object_key is not null then 'cached' else status end
          as status) from manifest m left join held on m.object_key = held.object_key""",
    "face_counts": """
        select feed_seq, case when front_png is not null and back_png is not null then 2 else 1 end
          as face_count from cards_feed""",
    "text_functions": f"""
        select sheet, row_no, {_norm("c")} as norm, {_blank("b")} as is_blank,
          case when not {_blank("j")} then j end as blank_to_null,
          array_to_string(list_transform(
            regexp_extract_all(lower(c), '[0-9]+|[^0-9]+'),
            lambda run: case when regexp_matches(run, '^[0-9]')
              then concat(lpad(cast(length(regexp_replace(run, '^0+([0-9])', '\\1')) as varchar),
                10, '0'), regexp_replace(run, '^0+([0-9])', '\\1'))
              else run end), '') as natural_key
        from grid""",
    "parse_functions": f"""
        select sheet, row_no, coalesce(lower(trim(d)) in
            ('sim', 's', 'yes', 'y', 'foil', 'true'), false) as foil_flag,
          {_CELL_TEXT} as cell_text, {_QUANTITY} as parse_quantity,
          coalesce(starts_with(lower(trim(i)), '*conferir sempre manualmente'), false)
            as manual_flag,
          cast(coalesce(cast(g_num as decimal(12,2)), try_cast(trim(g) as decimal(12,2))) as double)
            as cell_decimal
        from grid""",
    "date_functions": f"""
        select code, {_DATE.format("released_at")} as safe_date, cast(null as date) as date_of_time,
          {_DATE.format("released_at")} + interval '10 hours 22 minutes' as parse_ts,
          cast(null as timestamp) as time_of_date
        from sets_feed""",
    "card_functions": """
        select feed_seq,
          case when contains(name, ' // ') then array_to_string(string_split(name, ' // '), '|')
            else '' end as split_faces,
          cast(try_cast(usd as decimal(12,2)) as double) as plain_price,
          cast(try_cast(usd_foil as decimal(12,2)) as double) as foil_price,
          coalesce(png, front_png) as front_png, back_png,
          case when "set" is not null and collector_number is not null then
            concat(type_line, ' - ', "set", '/', collector_number, '-',
              replace(name, '/', '_'), '.png') end as object_key
        from cards_feed""",
    "read_sets_feed": _tagged(
        ("sets", f"select * exclude (feed_seq), {_AFTER} from sets_feed"),
        ("broken", _CUT_SHORT),
    ),
    "read_sets_files": _tagged(
        ("sets", f"select * exclude (feed_seq), {_AFTER} from sets_feed"),
        ("broken", """select '{"data":[{"code":' || chr(10) as text"""),
    ),
    "land_card_feed": _tagged(
        ("cards", "select * exclude (feed_seq) from cards_feed"),
        ("broken", _CUT_SHORT),
        ("counts", f"""
            select (select count(*) from cards_feed) as record_count,
              (select count(*) from ({_CUT_SHORT})) as broken_count"""),
    ),
    "read_card_feed": _tagged(
        ("cards", "select * exclude (feed_seq) from cards_feed"), ("broken", _CUT_SHORT)
    ),
    "read_batch_replies": _tagged(
        ("matched", f"""
            select name, "set", collector_number, type_line, layout, usd, usd_foil, {_AFTER}
            from cards_feed where "set" is not null"""),
        ("not_found", f"""
            select name, "set", collector_number, {_AFTER} from cards_feed where "set" is null"""),
        ("broken", _CUT_SHORT),
    ),
    "read_grid": "select * from grid",
}


def _with_views(text: str) -> str:
    """Put the views a statement names, and those they name, in front of it."""
    needed: dict[str, None] = {}

    def visit(body):
        for name in _CTES:
            if name not in needed and re.search(rf"\b(from|join|,)\s+{name}\b", body):
                visit(_CTES[name])
                needed[name] = None

    visit(text)
    ctes = ",\n".join(f"{name} as ({_CTES[name].strip()})" for name in needed)
    text = text.strip()
    if not ctes:
        return text
    return f"with {ctes},\n{text[5:]}" if text.startswith("with ") else f"with {ctes}\n{text}"


def all_checks() -> dict[str, str]:
    return {name: _with_views(text) for name, text in _CHECKS.items()}
