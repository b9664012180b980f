"""The same results in SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from .functions import paths
from .operators import hidden, keep
from .sources import adapters


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _under(path: str, folder: str) -> str:
    return f"({path} = '{folder}' or starts_with({path}, '{folder}/'))"


NAME, FOLDER = "regexp_extract(path, '[^/]*$')", "regexp_extract(path, '^(.*)/[^/]*$', 1)"
SUFFIX = rf"regexp_extract({NAME}, '^.+(\.[^.]+)$', 1)"
COPY = r"(?i)\bcopy\b|\(\d+\)|_\d+$|\.bak$"
IS_COPY = f"(regexp_matches({NAME}, '{COPY}') or regexp_matches(left({NAME}, len({NAME}) - len({SUFFIX})), '{COPY}'))"
INSIDE = f"case when {_under(FOLDER, '/r')} then substr({FOLDER}, 3) else {FOLDER} end"
DISPOSABLE = f"list_has_any(regexp_split_to_array(lower({INSIDE}), '[^a-z0-9]+'), {_list(paths.DISPOSABLE_WORDS)})"
PARTS = "list_filter(string_split(path, '/'), lambda x: x <> '')"
SHIELDED = _under("path", adapters.KEEP)
CATEGORY = "case " + " ".join(
    f"when list_contains({_list(e.split())}, lower({SUFFIX})) then '{k}'" for k, e in paths.CATEGORIES.items()
) + " else 'Other' end"

BASE = f"""
with files as ({adapters.FILES_SQL.format(size="strlen(text)")}),
single as (
  select size, device, inode, min(path) as path, min(mtime_ns) as mtime_ns, list_sort(list(path))[2:] as links, min(sha256(content)) as digest
  from files where size > 0 group by all
), grouped as (
  select size, digest, count(*) as n, min(path) as first_path from single group by all having count(*) > 1
), members as (
  select concat(substr(s.digest, 1, 12), '|', first_path) as group_id, s.digest as hash, path, s.size, mtime_ns, inode, device, links
  from single s join grouped g on s.size = g.size and s.digest = g.digest
)"""


def _rules(name: str, source: str, protected: str) -> str:
    """CTEs that end in ``name`` (group_id, winner, reason)."""
    reasons = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in (*keep.REASONS, keep.TIE)) + "]"
    low = ", ".join(f"min(r{k}) over w as low{k}, max(r{k}) over w as high{k}" for k in range(5))
    rule = " ".join(f"when low{k} < high{k} then {k}" for k in range(5))
    at = " ".join(f"when {k} then r{k} = low{k}" for k in range(5))
    return f""", {name}_keys as (
  select group_id, path, (not {protected})::int as r0, ({DISPOSABLE})::int as r1, {IS_COPY}::int as r2, mtime_ns as r3,
    len({PARTS}) * 100000 + len(path) as r4
  from {source}
), {name}_spread as (
  select *, {low} from {name}_keys window w as (partition by group_id)
), {name}_ruled as (
  select *, case {rule} else 5 end as rule from {name}_spread
), {name} as (
  select group_id, min(path) as winner, any_value({reasons}[rule + 1]) as reason
  from {name}_ruled where case rule {at} else true end group by group_id
)"""


PLAIN = BASE + _rules("won", "members", "false")
VERDICT = "case when kept then 'keep' else 'delete' end"
REASON = "case when kept then concat('Kept: ', reason) else concat('Duplicate of ', winner) end"
RECOMMENDED = BASE + _rules("won", "members", SHIELDED) + f""", recommended as (
  select m.*, case when any_protected then {SHIELDED.replace("path", "m.path")} else m.path = winner end as kept,
    case when any_protected then 'in a preferred folder' else reason end as reason, winner
  from members m join won using (group_id)
  join (select group_id, bool_or({SHIELDED}) as any_protected from members group by all) using (group_id)
)"""
SELECTED = """, selection as (
  select path from {source} where inode % 3 = 0 or mtime_ns % 7000000000 = 0 union all select '/r/nowhere.txt'
)"""
LISTING = """, listing as (
  select path, size, case when inode % 11 = 0 then mtime_ns + 1 else mtime_ns end as mtime_ns, inode, device from files where inode % 13 <> 0
)"""


def _bulk(name: str, chosen: str, reason: str) -> str:
    """Keep the best of ``chosen``; other groups as recommended."""
    return RECOMMENDED + f", chosen as ({chosen})" + _rules("best", "chosen", "false") + f""", ruled as (
  select m.group_id, path, (path = winner or {SHIELDED}) as kept, '{reason}' as reason, winner
  from members m join best using (group_id)
  union all select group_id, path, kept, reason, winner from recommended where group_id not in (select group_id from best)
) select group_id, path, {VERDICT} as verdict, {REASON} as reason from ruled"""


PLAN = RECOMMENDED + SELECTED.format(source="recommended") + """, keepers as (
  select group_id, count(*) as n_keepers, arg_min(path, (not kept, path)) as link_target,
    arg_min(device, (not kept, path)) as target_device, arg_min(inode, (not kept, path)) as target_inode
  from recommended where path not in (select path from selection) group by all
), planned as (
  select r.*, n_keepers, link_target, target_device, target_inode from recommended r left join keepers using (group_id)
  where path in (select path from selection)
)"""
PROBLEM = """case when l.path is null then 'no longer exists'
  when (l.size, l.mtime_ns, l.inode, l.device) <> (p.size, p.mtime_ns, p.inode, p.device)
  then 'size, modification time or identity differs from the scan' end"""
CHECKED = PLAN + LISTING + f""", checked as (
  select p.*, {PROBLEM} as problem from planned p left join listing l on p.path = l.path
), safe as (
  select distinct p.group_id from recommended p left join listing l on p.path = l.path
  where p.path not in (select path from planned) and ({PROBLEM}) is null
), linked as (
  select distinct p.group_id from recommended p left join listing l on p.path = l.path
  where p.path in (select link_target from planned) and p.path not in (select path from planned) and ({PROBLEM}) is null
)"""
DRY = CHECKED + """, dry as (
  select group_id, path, size, case when problem is not null then 'changed since scan'
    when group_id not in (select group_id from safe) then 'kept copy missing or changed' else 'would act' end as status,
    coalesce(problem, '') as detail
  from checked
)"""

KINDS = f"""case when starts_with(name, '~$') then 'Office lock file' when starts_with(name, '~') then 'Tilde file'
  when ends_with(name, '~') then 'Editor backup'
  when not is_dir and list_contains({_list(hidden.OS_METADATA)}, name) then 'OS metadata'
  when not is_dir and (ends_with(name, '.swp') or ends_with(name, '.swo')) then 'Editor swap file'
  when not is_dir and ends_with(name, '.tmp') then 'Temporary file'
  when starts_with(name, '.') and is_dir then 'Hidden folder' when starts_with(name, '.') then 'Hidden file' end"""
HIDDEN = BASE + f""", steps as (
  select path, size, {PARTS} as parts, unnest(range(2, len({PARTS}) + 1)) as lvl from files
), named as (
  select path, size, lvl, '/' || array_to_string(parts[1:lvl], '/') as item, parts[lvl] as name, lvl < len(parts) as is_dir from steps
), kinds as (select *, {KINDS} as category from named), topmost as (
  select * from kinds where category is not null qualify lvl = min(lvl) over (partition by path, size)
), items as (
  select item as path, is_dir, category, sum(size)::bigint as size, any_value(name) as name from topmost group by all
), states as (
  select path, is_dir, category, size, list_has_any({PARTS}, {_list(hidden.PROTECTED_NAMES)}) as protected,
    starts_with(path, '/r/home/.') as home_dot,
    (category in ('Office lock file', 'Editor backup') or name in ('.DS_Store', 'Thumbs.db')
      or (category = 'Editor swap file' and ends_with(name, '.swp')
        and path not in (select path from files where path like '%3.swp'))) as wanted
  from items
), hidden as (
  select path, is_dir, category, size, protected, home_dot, (not protected and not home_dot and wanted) as preselect from states
)"""

BITS = "list_sum(list_transform(range(0, 62), lambda i: case when {hit} then (1::bigint << i::int) else 0 end))::bigint"
HASHES = f"""
with signs as (
  select vec_id, {BITS.format(hit="embedding[i + 1] > 0")} as phash,
    {BITS.format(hit="embedding[i + 1] > embedding[i + 2]")} as dhash
  from embeddings
), hashes as (
  select vec_id as idx, phash, dhash from signs
  union all select vec_id + 100000, xor(phash, (1::bigint << (vec_id % 17)::int) - 1), xor(dhash, (1::bigint << (vec_id % 17)::int) - 1) from signs
), variants as (
  select idx, k, xor(phash, k * {adapters.MASK}) as vp, xor(dhash, k * {adapters.MASK}) as vd from hashes, range(0, 8) t(k)
)"""
NEAR = """, scored as (
  select v.idx as i, h.idx as j, k, bit_count(xor(vp, phash))::int as dp, bit_count(xor(vd, dhash))::int as dd
  from variants v join {hashes} h on v.idx < h.idx
), near as (
  select i, j, arg_min(k, (greatest(dp, dd), dp + dd, k))::int as variant, arg_min(dp, (greatest(dp, dd), dp + dd, k)) as dp,
    arg_min(dd, (greatest(dp, dd), dp + dd, k)) as dd
  from scored group by i, j having bool_or(dp <= 12 and dd <= 12)
)"""
SCENE = """, following as (
  select a.idx as a, b.idx as b, bit_count(xor(a.phash, b.phash))::int as dp, bit_count(xor(a.dhash, b.dhash))::int as dd
  from (select *, row_number() over (order by taken, idx) as n from shots) a
  join (select *, row_number() over (order by taken, idx) as n from shots) b on b.n between a.n + 1 and a.n + 6 and b.taken - a.taken <= 60
), scenes as (select least(a, b) as i, greatest(a, b) as j, 0 as variant, dp, dd from following)"""
MERGED = HASHES + NEAR.format(hashes="hashes") + ", shots as (select idx, idx % 977 * 20 as taken, phash, dhash from hashes)" + SCENE + """, merged as (
  select coalesce(h.i, t.i) as i, coalesce(h.j, t.j) as j, coalesce(h.variant, t.variant) as variant,
    coalesce(h.dp, t.dp) as dp, coalesce(h.dd, t.dd) as dd, t.i is not null as by_time
  from near h full join scenes t on h.i = t.i and h.j = t.j
)"""
META = HASHES + f""", meta as (
  select idx, concat(case when idx % 5 = 0 then '/r/Downloads/' else '/r/pics/' end, idx, case when idx % 3 = 0 then '_1.jpg' else '.jpg' end) as path,
    idx % 4 * 1000 as pixels, idx % 3 + 1 as size, idx % 11 as mtime_ns, (idx % 200)::varchar as group_id from hashes
), keyed as (
  select *, {IS_COPY} as c, {DISPOSABLE} as d, len({PARTS}) as n from meta
)"""
ORDER = "-pixels, -size, c, d, mtime_ns, n, len(path), path"
SNAPSHOTS = BASE + """, digests as (
  select path, size, mtime_ns, inode, device, sha256(content) as "full" from files
), old as (
  select path, size, mtime_ns, inode, device, case when inode % 2 = 0 then "full" end as "full", 'x' as perceptual from digests where inode % 3 <> 0
), new as (
  select path, size, case when inode % 7 = 0 then mtime_ns + 1 else mtime_ns end as mtime_ns, inode, device, "full",
    case when inode % 4 = 0 then 'y' end as perceptual from digests where inode % 5 <> 0
)"""

GROUPS = "select group_id, size, count(*) as n_files, sum(len(links))::bigint as n_links, (size * (count(*) - 1))::bigint as reclaimable from members group by group_id, size"
STATUS = RECOMMENDED + f""", checked as (
  select *, not {SHIELDED} and (case when inode % 4 = 0 then inode % 8 = 0 else not kept end) as checked from recommended
)"""

ORACLES: dict[str, str] = {
    "size_buckets": BASE + " select size, count(*) as n from files where size > 0 group by size having count(*) > 1",
    "exact_groups": BASE + " " + GROUPS,
    "exact_group_files": BASE + " select group_id, path, size, mtime_ns, inode, device from members",
    "partial_then_full": BASE + """ select path, size, sha256(content) as "full", count(*) over (partition by size, content) as sharing
      from files where size > 0 qualify count(*) over (partition by size, content) > 1""",
    "paranoid_groups": BASE + f" select group_id, size, n_files, reclaimable from ({GROUPS})",
    "hardlink_collapse": BASE + " select size, device, inode, path, mtime_ns, array_to_string(links, ';') as links from single",
    "hardlink_sets": BASE + """ select device, inode, array_to_string(list_transform(list_sort(list(string_split(path, '/'))), lambda x: array_to_string(x, '/')), ';') as paths
      from files where size > 0 group by device, inode having count(*) > 1""",
    "empty_files": BASE + " select path, inode from files where size = 0",
    "exclude_prune": BASE + r""" select path, size from files where not (
      list_contains(string_split(path, '/'), 'node_modules') or regexp_matches(path, '\.pdf(/|$)')
      or regexp_matches(path, '(^|/)a-b/.') or starts_with(path, '/r/photos/'))""",
    "no_hidden_prune": BASE + r" select path, size from files where not regexp_matches(substr(path, 3), '/\.')",
    "min_size": BASE + " select path, size from files where size >= 1500",
    "keep_rule": PLAIN + " select group_id, winner, reason from won",
    "keep_reason": PLAIN + f" select group_id, path, {VERDICT} as verdict, {REASON} as reason from (select m.group_id, path, path = winner as kept, winner, reason from members m join won using (group_id))",
    "keep_protected": RECOMMENDED + f" select group_id, path, {VERDICT} as verdict, {REASON} as reason from recommended",
    "keep_newest": _bulk("n", "select * from members qualify mtime_ns = max(mtime_ns) over (partition by group_id)", "newest modification time"),
    "keep_in_folder": _bulk("f", f"select * from members where {_under('path', '/r/docs')}", "in folder /r/docs"),
    "suggested_deletions": RECOMMENDED + " select distinct path from recommended where not kept",
    "mark_keep": BASE + """, chosen as (select group_id, max(path) as kept from members where mtime_ns % 5000000000 = 0 group by all)
      select group_id, path, path <> kept as selected from members join chosen using (group_id)""",
    "view_by_type": BASE + f" select group_id, path, size from members where group_id in (select group_id from members where {CATEGORY} = 'Images')",
    "view_by_text": BASE + " select group_id, path, size from members where group_id in (select group_id from members where contains(lower(path), 'downloads/copy'))",
    "view_sort_count": BASE + f" select group_id, n_files, reclaimable, size from ({GROUPS}) order by n_files desc, reclaimable desc",
    "view_sort_name": BASE + f" select group_id, min(lower({NAME})) as first_name, min(lower(path)) as first_lower_path from members group by group_id order by first_name",
    "view_places": BASE + f""", named as (
        select group_id, hash, size, count(*) as n, size * (count(*) - 1) as reclaimable, min(lower({NAME})) as first_name,
          min(lower(path)) as first_path from members group by group_id, hash, size
      ) select 'reclaimable' as sort, group_id, row_number() over (order by reclaimable desc, hash, group_id) - 1 as place from named
      union all select 'size', group_id, row_number() over (order by size desc, reclaimable desc, hash, group_id) - 1 from named
      union all select 'count', group_id, row_number() over (order by n desc, reclaimable desc, hash, group_id) - 1 from named
      union all select 'name', group_id, row_number() over (order by first_name, hash, group_id) - 1 from named
      union all select 'path', group_id, row_number() over (order by first_path, hash, group_id) - 1 from named""",
    "view_representatives": BASE + f" select group_id, min(path) as representative from members where {CATEGORY} = 'Images' group by group_id",
    "row_status": STATUS + f" select group_id, path, checked, case when {SHIELDED} then 'protected' when checked then 'delete' else 'keep' end as status from checked",
    "selection_totals": STATUS + " select count(*) filter (checked) as n_selected, coalesce(sum(size) filter (checked), 0)::bigint as selected_size from checked",
    "scan_totals": BASE + f" select (select count(*) from files) as files_scanned, count(*) as n_groups, coalesce(sum(reclaimable), 0)::bigint as reclaimable from ({GROUPS})",
    "exact_json": BASE + """ select group_id, concat('{"hash":"', hash, '","size":', size, ',"reclaimable":', size * (count(*) - 1), ',"files":[',
      string_agg(concat('{"path":"', path, '","size":', size, ',"mtime_ns":', mtime_ns, '}'), ',' order by path), '],"hardlinked":[',
      array_to_string(list_transform(list_sort(flatten(list(links))), lambda x: concat('"', x, '"')), ','), ']}') as json
      from members group by group_id, hash, size""",
    "hidden_items": HIDDEN + """ select *, concat_ws('; ', case when protected then 'Protected: essential configuration' end,
      case when home_dot then 'Inside a hidden folder of your home' end) as notes from hidden""",
    "hidden_json": HIDDEN + """ select path, concat('{"path":"', path, '","type":"', case when is_dir then 'folder' else 'file' end, '","size":', size,
      ',"category":"', category, '","protected":', protected, ',"home_toplevel_dot":', home_dot, ',"preselect":', preselect, '}') as json from hidden""",
    "hidden_preselected": HIDDEN + " select coalesce(sum(size) filter (preselect), 0)::bigint as reclaimable_preselected, count(*) filter (preselect) as n from hidden",
    "tree_size": BASE + f""", steps as (select size, {PARTS} as parts, unnest(range(1, len({PARTS}))) as lvl from files)
      select '/' || array_to_string(parts[1:lvl], '/') as folder, count(*) as n_files, sum(size)::bigint as size from steps group by folder""",
    "category_by_ext": BASE + f" select {CATEGORY} as category, lower({SUFFIX}) as suffix, count(*) as n, sum(size)::bigint as size from files group by all",
    "human_size": BASE + """ select path, case when size * 1000 < 1024 then concat(size * 1000, ' B') when size * 1000 < 1048576 then printf('%.1f KiB', size * 1000 / 1024.0::double)
      when size * 1000 < 1073741824 then printf('%.1f MiB', size * 1000 / 1048576.0::double) else printf('%.1f GiB', size * 1000 / 1073741824.0::double) end as human from files""",
    "image_filter": BASE + f" select path, size from files where size > 0 and list_contains({_list([x for x in paths.RASTER if x not in paths.NEEDS_CODEC])}, lower({SUFFIX}))",
    "collapse_exact": RECOMMENDED + """, known as (
      select s.path, s.links, r.group_id, r.kept from single s left join recommended r on s.path = r.path
    ), heads as (select group_id, arg_min(path, (not kept, path)) as head from known where group_id is not null group by all having count(*) > 1),
    merged as (select coalesce(head, path) as stands, path, links from known left join heads using (group_id))
    select stands as path, array_to_string(list_sort(flatten(list(case when path = stands then links else list_concat([path], links) end))), ';') as aliases
    from merged group by stands""",
    "hamming_candidates": HASHES + ", ok as (select * from hashes where bit_count(phash) between 3 and 61), okv as (select * from variants where idx in (select idx from ok))"
    + NEAR.format(hashes="ok").replace("from variants v", "from okv v") + " select i, j, variant, dp, dd from near",
    "best_variant": HASHES + """, scored as (
      select v.idx, k, bit_count(xor(vp, phash))::int as dp, bit_count(xor(vd, dhash))::int as dd from variants v join hashes h on h.idx = v.idx + 100000)
      select idx, arg_min(k, (greatest(dp, dd), dp + dd, k))::int as variant, arg_min(dp, (greatest(dp, dd), dp + dd, k)) as dp,
        arg_min(dd, (greatest(dp, dd), dp + dd, k)) as dd from scored group by idx""",
    "scene_pairs": "with shots as (select event_id as idx, floor(epoch_us(ts) / 1000000)::bigint as taken, event_id * 7919 % 65536 as phash, event_id * 104729 % 65536 as dhash from events)"
    + SCENE + " select i, j, variant, dp, dd from scenes",
    "merge_candidates": MERGED + " select i, j, variant, dp, dd, by_time from merged",
    "verify_threshold": MERGED + " select i, j, variant, dp as distance, 1 - dp / 64.0::double as similarity from merged where dp <= 8 and dd <= 8",
    "quality_rank": META + f" select idx, path, row_number() over (order by {ORDER})::int as rank from keyed",
    "similar_verdicts": META + f""", ranked as (select *, row_number() over (partition by group_id order by {ORDER})::int as rank from keyed),
      heads as (select group_id, max(path) filter (rank = 1) as best,
        case when count(*) < 2 or min(pixels) < max(pixels) then 'highest resolution' when min(size) < max(size) then 'larger file' else 'best-ranked copy' end as why
        from ranked where rank <= 2 group by group_id)
      select group_id, path, rank, case when rank = 1 or {_under('path', '/r/Downloads')} then 'keep' else 'delete' end as verdict,
        case when rank = 1 then concat('Kept: ', why) when {_under('path', '/r/Downloads')} then 'Kept: in a preferred folder' else concat('Similar to ', best) end as reason
      from ranked join heads using (group_id)""",
    "plan_unknown": BASE + SELECTED.format(source="members") + " select concat(path, ': not part of any duplicate group') as reason from selection where path not in (select path from members)",
    "plan_protected": BASE + SELECTED.format(source="members") + f" select concat(path, ': is in a protected folder') as reason from selection where {SHIELDED}",
    "plan_items": PLAN + " select group_id, path, size, n_keepers, link_target from planned",
    "hardlink_feasible": PLAN + """ select case when link_target is null then concat(path, ': no kept copy to link to') else concat(path, ': on a different filesystem than ', link_target) end as reason
      from planned where link_target is null or target_device <> device order by group_id, path limit 1""",
    "groups_after": BASE + SELECTED.format(source="members") + """ select group_id, path, size from members where path not in (select path from selection)
      qualify count(*) over (partition by group_id) > 1""",
    "similar_groups_after": META + """ select group_id, path, case when idx % 2 = 0 then concat(path, '~b') else concat(path, '~a;', path, '~b') end as aliases
      from meta where idx % 3 <> 0 qualify count(*) over (partition by group_id) > 1""",
    "reverify": CHECKED + " select path, problem from checked",
    "dry_run": DRY + " select group_id, path, size, status, detail from dry",
    "dry_run_hardlink": CHECKED + """ select path, case when problem is not null then 'changed since scan' when group_id not in (select group_id from linked) then 'kept copy missing or changed'
        when target_device <> device then 'failed' when target_inode = inode then 'already hard-linked' else 'would act' end as status,
      case when problem is not null then problem when group_id in (select group_id from linked) and target_device <> device then 'different filesystem' else '' end as detail from checked""",
    "action_log": CHECKED + """, logged as (
        select *, case when problem is not null then 'changed since scan' when group_id not in (select group_id from linked) then 'kept copy missing or changed'
          when target_device <> device then 'failed' when target_inode = inode then 'already hard-linked' else 'would act' end as status
        from checked
      ) select 'hardlink' as action, 'file' as kind, path, size, hash, status,
        case when problem is not null then problem when status = 'failed' then 'different filesystem' end as detail, link_target as linked_to from logged""",
    "dry_run_summary": DRY + " select status, count(*) as n, coalesce(sum(size) filter (status = 'would act'), 0)::bigint as freed from dry group by status",
    "dry_run_examples": DRY + " select path, status, row_number() over (partition by status order by group_id, path)::int as place from dry where status <> 'would act' qualify place <= 10",
    "hidden_plan": HIDDEN + " select distinct concat(path, ': is on the protected list and was not explicitly confirmed') as reason from hidden where protected and path not like '%1.swp'",
    "cache_hits": SNAPSHOTS + LISTING + """ select l.path, o."full", o.perceptual from listing l left join old o
      on (l.path, l.size, l.mtime_ns, l.inode, l.device) = (o.path, o.size, o.mtime_ns, o.inode, o.device)""",
    "cache_upsert": SNAPSHOTS + """ select coalesce(n.path, o.path) as path, coalesce(n.mtime_ns, o.mtime_ns) as mtime_ns, case when n.path is null then o."full" else n."full" end as "full",
      case when n.path is null then o.perceptual when n.mtime_ns = o.mtime_ns then coalesce(n.perceptual, o.perceptual) else n.perceptual end as perceptual,
      o.path is not null and (n.path is null or n.mtime_ns = o.mtime_ns) as has_partial
      from old o full join new n on o.path = n.path""",
}
_LAST = """, lost as (
  select min(path) as first, any_value(hash) as hash from members group by group_id
  having count(*) = count(*) filter (path in (select path from selection)))
  select concat('every copy of ', regexp_extract(first, '[^/]*$'), ' (', substr(hash, 1, 12), ') is selected; at least one copy must be kept') as reason from lost"""
ORACLES["plan_last_copy"] = BASE + SELECTED.format(source="members") + _LAST
ORACLES["plan_refusals"] = (
    BASE + SELECTED.format(source="members") + _LAST
    + " union all select concat(path, ': not part of any duplicate group') from selection where path not in (select path from members)"
    + f" union all select concat(path, ': is in a protected folder') from selection where {SHIELDED}"
)
# one step for each image in order of rank, carrying the ranks of the leaders so far
ORACLES["leader_clusters"] = (MERGED + META[len(HASHES) :]).replace("with signs", "with recursive signs", 1) + f""", ranked as (
  select idx, row_number() over (order by {ORDER})::int as rank from keyed
), links as (
  select i, j from merged where dp <= 8 and dd <= 8 union select j, i from merged where dp <= 8 and dd <= 8
), nearby as materialized (
  select r.rank, r.idx, coalesce(list(o.rank) filter (o.rank is not null), []) as others
  from ranked r left join links on r.idx = i left join ranked o on o.idx = j group by r.rank, r.idx
), walk as (
  select 0 as k, []::int[] as leaders
  union all select k + 1, case when list_has_any(others, leaders) then leaders else list_append(leaders, rank) end
  from walk join nearby on rank = k + 1
), chosen as (select leaders from walk order by k desc limit 1)
select n.idx, l.idx as leader from nearby n, chosen join nearby l
  on l.rank = case when list_contains(leaders, n.rank) then n.rank else list_min(list_intersect(n.others, leaders)) end"""

_BEST = META + f""", ranked as (select *, row_number() over (partition by group_id order by {ORDER})::int as rank from keyed)"""
_SHIELD = _under("path", "/r/Downloads")
ORACLES |= {
    "plan_total_size": PLAN + " select count(*) as n, coalesce(sum(size), 0)::bigint as total_size from planned",
    "plan_decided": RECOMMENDED + SELECTED.format(source="members") + _LAST.replace(" select concat('every", " , final as (select concat('every", 1) + f""")
      select path, 'planned' as what from recommended where not kept
      union all select reason, 'refused' from final
      union all select concat(path, ': not part of any duplicate group'), 'refused' from selection where path not in (select path from members)
      union all select concat(path, ': is in a protected folder'), 'refused' from selection where {SHIELDED}
      union all select 'nothing selected', 'refused'""",
    "plan_similar": _BEST + f""" select group_id, path, size, (select count(*) from ranked o where o.group_id = r.group_id and not (rank > 1 and idx % 5 <> 0)) as n_keepers
      from ranked r where rank > 1 and idx % 5 <> 0 and not exists (select 1 from ranked where rank > 1 and idx % 5 <> 0 and {_SHIELD})""",
    "plan_similar_refusals": META + f""" select concat(path, ': is in a protected folder') as reason from meta where (idx % 3 = 0 or group_id = '7') and {_SHIELD}
      union all select concat('every image in the similar group of ', regexp_extract(min(path), '[^/]*$'), ' is selected; at least one must be kept')
        from meta group by group_id having bool_and(idx % 3 = 0 or group_id = '7')
      union all select '/r/nowhere.jpg: not part of any similar-image group'
      union all select 'hard links are never used for similar images: they are different pictures, so linking would replace one with the other'""",
    "similar_status": _BEST + f""" select group_id, path, not {_SHIELD} and idx % 8 = 0 as checked,
      case when {_SHIELD} then 'protected' when idx % 8 = 0 then 'delete' else 'keep' end as status,
      case when rank = 1 or {_SHIELD} then 'keep' else 'delete' end as suggestion from ranked""",
    "similar_group_order": _BEST + """ select group_id, count(*) as n, coalesce(sum(size) filter (rank > 1), 0)::bigint as reclaimable,
      row_number() over (order by coalesce(sum(size) filter (rank > 1), 0) desc, group_id) - 1 as place from ranked group by group_id""",
    "similar_totals": _BEST + """ select count(distinct group_id) as n_groups, count(*) as n_images,
      coalesce(sum(size) filter (rank > 1), 0)::bigint as reclaimable from ranked""",
    "hidden_risky": HIDDEN + " select path, size from hidden where protected or home_dot",
    "mtime_shown": BASE + " select path, strftime(make_timestamp(mtime_ns // 1000), '%Y-%m-%d %H:%M') as shown from files",
    "mode_shown": BASE + """, modes as (select path, (inode * 7919 % 65536)::int as mode from files)
      select path, mode, concat(case mode >> 12 when 1 then 'p' when 2 then 'c' when 4 then 'd' when 6 then 'b' when 8 then '-' when 10 then 'l' when 12 then 's' else '?' end,
        case when mode & 256 > 0 then 'r' else '-' end, case when mode & 128 > 0 then 'w' else '-' end,
        substr('-xSs', (2 * (mode >> 11 & 1) + (mode >> 6 & 1) + 1)::int, 1),
        case when mode & 32 > 0 then 'r' else '-' end, case when mode & 16 > 0 then 'w' else '-' end,
        substr('-xSs', (2 * (mode >> 10 & 1) + (mode >> 3 & 1) + 1)::int, 1),
        case when mode & 4 > 0 then 'r' else '-' end, case when mode & 2 > 0 then 'w' else '-' end,
        substr('-xTt', (2 * (mode >> 9 & 1) + (mode & 1) + 1)::int, 1),
        ' (', mode >> 9 & 7, mode >> 6 & 7, mode >> 3 & 7, mode & 7, ')') as shown from modes""",
    "pixel_similarity": """with points as (
        select vec_id, (k - 1) // 8 as r, (k - 1) % 8 as c, greatest(0, least(255, floor(embedding[k]::double * 512 + 128))) as v
        from embeddings, (select unnest(range(1, 65)) as k) where len(embedding) >= 64
      ), windows as (
        select a.vec_id as i, top, side, avg(a.v) as mx, avg(b.v) as my, var_samp(a.v) as vx, var_samp(b.v) as vy, covar_samp(a.v, b.v) as vxy
        from points a join points b on b.vec_id = a.vec_id + 1 and a.r = b.r and a.c = b.c
        join (select unnest(range(2)) as top) on a.r between top and top + 6 join (select unnest(range(2)) as side) on a.c between side and side + 6
        group by all
      ) select i, i + 1 as j, round(avg((2 * mx * my + 6.5025) * (2 * vxy + 58.5225) / ((mx * mx + my * my + 6.5025) * (vx + vy + 58.5225))), 6) as similarity
      from windows group by i""",
    "image_cache_states": HASHES + """ select concat('/r/pics/', idx, '.jpg') as path,
      case when idx % 5 = 0 then 'new' when idx % 13 = 0 then 'changed' when idx % 17 = 0 then 'stamp' else 'hit' end as state from hashes""",
    "image_cache_hits": HASHES + """ select concat('/r/pics/', idx, '.jpg') as path, 640 as width, case when idx % 3 = 0 then idx * 60 end as taken, phash,
      8 as n_variants from hashes where idx % 5 <> 0 and idx % 13 <> 0 and idx % 17 <> 0""",
    "image_cache_renewed": HASHES + """, told as (select *, idx % 5 <> 0 and idx % 13 <> 0 and idx % 17 <> 0 as hit from hashes)
      select concat('/r/pics/', idx, '.jpg') as path, idx % 11 + (idx % 13 = 0)::bigint as mtime_ns, if(hit, 640, 64) as width, true as current from told""",
    "perceptual_text": HASHES + """, forms as (
        select idx, string_agg(format('{:016x}{:016x}', vp, vd), ';' order by k) as body from variants group by idx)
      select concat('/r/pics/', idx, '.jpg') as path, true as same, true as refused,
        concat('640,480', case when idx % 3 = 0 then concat(',', idx * 60) else '' end, ';', body) as text from forms where idx % 5 <> 0""",
    "gone_paths": CHECKED + """ select path from checked
      where problem is null and inode % 2 = 0 and link_target is not null and group_id in (select group_id from linked)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
