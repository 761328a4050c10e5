"""The registered queries as DuckDB SQL, written from their definitions.

Shared pieces are text fragments; every common table expression that is used
twice is materialised, and joins have single-column keys where they are many.
"""

from __future__ import annotations

import math

SQL: dict[str, str] = {}

EMB = """emb as materialized (select vec_id as id, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z,
  embedding[4]::double as a, embedding[5]::double as b, embedding[6]::double as c, label::bigint as label from embeddings),
cloud as materialized (select id, x, y, z, a/sqrt(a*a+b*b+c*c) as nx, b/sqrt(a*a+b*b+c*c) as ny, c/sqrt(a*a+b*b+c*c) as nz, label from emb)"""
EVT = """cloud as materialized (select event_id as id, user_id::double/150.0::double as x,
  (cast(floor(epoch(ts)) as bigint)%86400)::double/86400.0::double as y, value/500.0::double as z from events)"""
PART = """cloud as materialized (select p_partkey as id, p_size::double/50.0::double as x, (p_retailprice-900.0::double)/100.0::double as y,
  (p_partkey%97)::double/97.0::double as z from part)"""
FLAT = """cloud as materialized (select p_partkey as id, p_size::double/50.0::double as x, (p_retailprice-900.0::double)/100.0::double as y,
  0.0::double as z from part)"""
KD = "kd as materialized (select vec_id as id, list_transform(embedding, lambda v: v::double) as coords from embeddings)"


def r6(e: str, name: str) -> str:
    return f"round(({e})::double, 6) + 0.0 as {name}"


def r6s(*names: str) -> str:
    return ", ".join(r6(n, n) for n in names)


def d2(a: str, b: str) -> str:
    return f"(({b}.x-{a}.x)*({b}.x-{a}.x)+({b}.y-{a}.y)*({b}.y-{a}.y)+({b}.z-{a}.z)*({b}.z-{a}.z))"


def apart(a: str, b: str, eps: str = "1e-5") -> str:
    return f"not (abs({b}.x-{a}.x)<{eps} and abs({b}.y-{a}.y)<{eps} and abs({b}.z-{a}.z)<{eps})"


def knn(k: int, q: str = "cloud", c: str = "cloud", name: str = "nbr") -> str:
    return f"""{name} as materialized (select * from (select q.id, c.id as nid, {d2("q", "c")} as d2,
  row_number() over (partition by q.id order by {d2("q", "c")}, c.id)::bigint as rank, c.x, c.y, c.z
  from {q} q, {c} c where {apart("q", "c")}) where rank <= {k})"""


def near(r: str, q: str = "cloud", c: str = "cloud", name: str = "nbr", where: str = "true") -> str:
    return f"{name} as materialized (select q.id, c.id as nid, {d2('q', 'c')} as d2, q.x as qx, q.y as qy, q.z as qz, c.x, c.y, c.z from {q} q, {c} c where {d2('q', 'c')} <= ({r})*({r}) and {where})"


def eigen(source: str, keep: str, name: str = "eig") -> str:
    """Eigenvalues of cxx..czz."""
    return f"""{name}_1 as (select {keep}, cxx, cxy, cxz, cyy, cyz, czz, (cxx+cyy+czz)/3 as q from {source}),
{name}_2 as (select *, sqrt(((cxx-q)*(cxx-q)+(cyy-q)*(cyy-q)+(czz-q)*(czz-q)+2*(cxy*cxy+cxz*cxz+cyz*cyz))/6) as p from {name}_1),
{name}_3 as (select *, case when p>0 then acos(least(1.0, greatest(-1.0, ((cxx-q)*((cyy-q)*(czz-q)-cyz*cyz)-cxy*(cxy*(czz-q)-cyz*cxz)+cxz*(cxy*cyz-(cyy-q)*cxz))/(2*p*p*p))))/3 else acos(0.0)/3 end as phi from {name}_2),
{name}_4 as (select *, q+2*p*cos(phi) as l2, q+2*p*cos(phi+2*pi()/3) as l0 from {name}_3),
{name} as materialized (select *, 3*q-l0-l2 as l1 from {name}_4)"""


def eigenvector(source: str, value: str, name: str) -> str:
    """Unit vector vx, vy, vz (any sign) of an eigenvalue column: the longest cross product of two rows."""
    return f"""{name}_k as (select *, unnest([
  {{'x': cxy*cyz-cxz*(cyy-{value}), 'y': cxz*cxy-(cxx-{value})*cyz, 'z': (cxx-{value})*(cyy-{value})-cxy*cxy}},
  {{'x': cxy*(czz-{value})-cxz*cyz, 'y': cxz*cxz-(cxx-{value})*(czz-{value}), 'z': (cxx-{value})*cyz-cxy*cxz}},
  {{'x': (cyy-{value})*(czz-{value})-cyz*cyz, 'y': cyz*cxz-cxy*(czz-{value}), 'z': cxy*cyz-(cyy-{value})*cxz}}]) as v from {source}),
{name} as materialized (select * exclude (v, len, rn), v.x/sqrt(len) as vx, v.y/sqrt(len) as vy, v.z/sqrt(len) as vz from
  (select *, v.x*v.x+v.y*v.y+v.z*v.z as len, row_number() over (partition by id order by v.x*v.x+v.y*v.y+v.z*v.z desc) as rn from {name}_k) where rn = 1)"""


PLANES = f"""mom as materialized (select n.id, any_value(q.x) as qx, any_value(q.y) as qy, any_value(q.z) as qz, count(*) as n, sum(n.x-q.x) as sx, sum(n.y-q.y) as sy, sum(n.z-q.z) as sz,
  sum((n.x-q.x)*(n.x-q.x)) as sxx, sum((n.x-q.x)*(n.y-q.y)) as sxy, sum((n.x-q.x)*(n.z-q.z)) as sxz, sum((n.y-q.y)*(n.y-q.y)) as syy, sum((n.y-q.y)*(n.z-q.z)) as syz, sum((n.z-q.z)*(n.z-q.z)) as szz
  from nbr n join cloud q on q.id = n.id group by n.id),
cov as materialized (select id, n, qx+sx/n as ox, qy+sy/n as oy, qz+sz/n as oz, sxx-sx*sx/n as cxx, sxy-sx*sy/n as cxy, sxz-sx*sz/n as cxz, syy-sy*sy/n as cyy, syz-sy*sz/n as cyz, szz-sz*sz/n as czz from mom),
{eigen("cov", "id, n, ox, oy, oz")},
{eigenvector("eig", "l0", "nrm")}"""

MEANS = f"{EMB}, {knn(5)}, m as materialized (select id, avg(sqrt(d2)) as m from nbr group by id)"

SQL["vector_math"] = f"""with {EMB}, p as (select a.*, b.x as bx, b.y as by_, b.z as bz from cloud a join cloud b on b.id = a.id+1)
select id, {r6("x*bx+y*by_+z*bz", "dot")}, {r6("sqrt(x*x+y*y+z*z)", "len")}, {r6("sqrt((x-bx)*(x-bx)+(y-by_)*(y-by_)+(z-bz)*(z-bz))", "dist")},
{r6("3*sqrt(x*x+y*y+z*z)", "scaled")}, {r6("sqrt((y*bz-z*by_)*(y*bz-z*by_)+(z*bx-x*bz)*(z*bx-x*bz)+(x*by_-y*bx)*(x*by_-y*bx))", "area")}, {r6("(x+bx)/2", "mid_x")}, {r6("(x-bx)*(x-bx)+(y-by_)*(y-by_)+(z-bz)*(z-bz)", "d2")} from p"""
SQL["kernel_functions"] = f"""with {EMB}, p as (select *, sqrt(x*x+y*y+z*z) as r, (0.1::double-x)*nx+(0.0::double-y)*ny+(-0.1::double-z)*nz as t from cloud)
select id, {r6("exp(-r*r/(2*0.3::double*0.3::double))/(0.3::double*sqrt(2*pi()))", "gauss")}, {r6("-r*exp(-r*r/(2*0.3::double*0.3::double))/(0.3::double*0.3::double*0.3::double*sqrt(2*pi()))", "dgauss")},
{r6("exp(-r*r/(0.8::double*0.8::double/16))", "theta")}, {r6("x+t*nx", "tx")}, {r6("y+t*ny", "ty")}, {r6("z+t*nz", "tz")} from p"""
SQL["eps_equality_pairs"] = f"with {FLAT} select a.id, b.id as nid from cloud a join cloud b on a.id < b.id and not ({apart('a', 'b')})"
SQL["plane_signed_distance"] = f"with {EMB}, p as (select id, (x-0.05::double)*0.6::double+z*0.8::double as d from cloud) select id, {r6('d', 'distance')}, abs(d) < 0.01 as near from p"
SQL["sphere_search"] = f"with {EVT} select id, x, y, z from cloud where (x-0.05::double)*(x-0.05::double)+(y-0.5::double)*(y-0.5::double)+(z-0.1::double)*(z-0.1::double) <= 0.2::double*0.2::double"
SQL["box_search"] = f"with {EVT} select id, x, y, z from cloud where x between 0.0::double and 0.08::double and y between 0.25::double and 0.5::double and z between 0.05::double and 0.2::double"
SQL["box_join"] = f"""with {EVT}, b as (select range as qid, range*0.125::double as lo, range*0.125::double+0.2::double as hi from range(8))
select qid, count(*) as n, min(id) as first_id from b join cloud on y between lo and hi and x between 0 and 0.05::double and z between 0.02::double and 0.09::double group by qid"""
SQL["kd_box_search"] = "select vec_id as id from embeddings where list_min(embedding)::double >= -0.3::double and list_max(embedding)::double <= 0.35::double"
_CLAMP = {n: f"least(greatest({n}, -0.1::double), 0.15::double)" for n in "xyz"}
_MID = "((-0.1::double+0.15::double)/2)"
SQL["box_center_nearest_point"] = f"""with {EMB} select id, {", ".join(r6(_CLAMP[n], f"p{n}") for n in "xyz")}, {r6("+".join(f"(x-{_MID})*(x-{_MID})".replace("x", n) for n in "xyz"), "center_d2")},
{" and ".join(f"({n} between -0.1::double and 0.15::double)" for n in "xyz")} as inside from cloud"""
SQL["kd_nearest_point"] = f"""with {KD}, u as (select id, unnest(coords) as v from kd)
select id, {r6("sum((least(greatest(v, -0.05::double), 0.05::double)-v)*(least(greatest(v, -0.05::double), 0.05::double)-v))", "d2")}, bool_and(v between -0.05::double and 0.05::double) as touches from u group by id"""


def _box_gap(n: str) -> str:
    return f"least(greatest(b.{n}, a.{n}-a.r), a.{n}+a.r)-b.{n}"


SQL["intersections"] = f"""with {EMB}, s as materialized (select id, x, y, z, 0.02::double+(id%5)*0.03::double as r from cloud)
select a.id, count(*) filter ({" and ".join(f"(a.{n}-a.r <= b.{n}+b.r and b.{n}-b.r <= a.{n}+a.r)" for n in "xyz")}) as boxes, count(*) filter ({d2("a", "b")} <= (a.r+b.r)*(a.r+b.r)) as balls,
count(*) filter ({"+".join(f"({_box_gap(n)})*({_box_gap(n)})" for n in "xyz")} <= b.r*b.r) as box_ball from s a join s b on a.id <> b.id group by a.id"""
SQL["grid_containing"] = f"""with {EMB}, b as (select min(x) as x0, min(y) as y0, min(z) as z0, (max(x)-min(x))/10 as dx, (max(y)-min(y))/8 as dy, (max(z)-min(z))/6 as dz from cloud)
select {r6("x0-dx", "x")}, {r6("y0-dy", "y")}, {r6("z0-dz", "z")}, {r6s("dx", "dy", "dz")}, 12::bigint as sx, 10::bigint as sy, 8::bigint as sz from b"""
SQL["voxel_index"] = f"""with {EMB}, g as (select id, floor((x-(-0.5::double-0.1::double))/0.1::double)::bigint as i, floor((y-(-0.5::double-0.125::double))/0.125::double)::bigint as j,
  floor((z-(-0.5::double-1.0::double/6))/(1.0::double/6))::bigint as k from cloud)
select id, i, j, k, i+j*12+k*120 as cell, i as i2, j as j2, k as k2, {r6("-0.5::double-0.1::double+i*0.1::double", "wx")}, {r6("-0.5::double-0.125::double+j*0.125::double", "wy")}, {r6("-0.5::double-1.0::double/6+k*(1.0::double/6)", "wz")} from g"""
SQL["bounding_box"] = f"with {EVT} select {', '.join(f'{f}({n}) as {n}{f}' for f in ('min', 'max') for n in 'xyz')} from cloud"
SQL["kd_bounding_box"] = f"with {KD}, u as (select unnest(coords) as v, generate_subscripts(coords, 1)-1 as axis from kd) select axis::bigint as axis, {r6('min(v)', 'low')}, {r6('max(v)', 'high')} from u group by axis"
SQL["center_of_geometry"] = f"with {EMB} select label, count(*) as n, {', '.join(r6(f'avg({n})', f'c{n}') for n in 'xyz')} from cloud group by label"
_COV = f"""{EMB}, mu as materialized (select label as id, avg(x) as mx, avg(y) as my, avg(z) as mz from cloud group by label),
cov as materialized (select m.id, count(*) as n, sum((x-mx)*(x-mx)) as cxx, sum((x-mx)*(y-my)) as cxy, sum((x-mx)*(z-mz)) as cxz, sum((y-my)*(y-my)) as cyy, sum((y-my)*(z-mz)) as cyz, sum((z-mz)*(z-mz)) as czz
  from cloud c join mu m on c.label = m.id group by m.id)"""
SQL["scatter_matrix"] = f"with {_COV} select id as label, n, {r6s('cxx', 'cxy', 'cxz', 'cyy', 'cyz', 'czz')} from cov"
SQL["pca"] = f"with {_COV}, {eigen('cov', 'id, n')} select id as label, n, {r6s('l0', 'l1', 'l2')}, 0.0::double as dot_v1, 0.0::double as dot_v2 from eig"
SQL["mean_knn_distance"] = f"with {MEANS} select id, {r6s('m')} from m"
SQL["avg_knn_distance"] = f"with {MEANS} select {r6('avg(m)', 'm')} from m"
SQL["knn_distance_spread"] = f"with {MEANS} select count(*) as n, {r6('avg(m)', 'mean')}, {r6('var_pop(m)*count(*)', 'sum_sq_dev')}, {r6('var_pop(m)', 'var_pop')} from m"
SQL["max_density_point"] = f"with {MEANS} select id, {r6s('m')} from m order by m.m, id limit 1"
SQL["density"] = f"with {PART}, {near('0.1::double')} select id, count(*) as n, round(count(*)/(4.0::double/3*pi()*0.1::double*0.1::double*0.1::double), 3)+0.0 as density from nbr group by id"
SQL["cloud_folds"] = f"with {EVT} select count(*) as n, {r6('sum(x)', 'sum_x')}, (count(*) filter (z > 0.1::double))::bigint as n_high, bool_and(z >= 0) as all_high, bool_and(y <= 2) as none_far, (select id from cloud order by z, id limit 1) as lowest, (select id from cloud order by z desc, id desc limit 1) as highest from cloud"
_W = "exp(-d2/(2*0.04::double*0.04::double))"
SQL["kernel_weighted_mean"] = f"with {PART}, {near('0.08::double')} select id, {', '.join(r6(f'sum({_W}*{n})/sum({_W})', n) for n in 'xyz')} from nbr group by id"
SQL["knn_self"] = f"with {EMB}, {knn(5)} select id, nid, rank, {r6s('d2')} from nbr"
SQL["knn_foreign"] = f"with {EMB}, odd as (select * from cloud where id%2 = 1), even as (select * from cloud where id%2 = 0), {knn(4, 'odd', 'even')} select id, nid, rank, {r6s('d2')} from nbr"
SQL["knn_outlier"] = f"with {EMB}, far as materialized (select id, x, y, z from cloud union all select -1, 1000.0, 1000.0, 1000.0), {knn(5, 'far', 'far')} select id, nid, rank, {r6s('d2')} from nbr"
SQL["knn_coincident"] = f"with {FLAT}, {knn(3)} select id, nid, rank, {r6s('d2')} from nbr"
SQL["knn_kd"] = f"""with {KD}, p as materialized (select q.id, c.id as nid, list_sum(list_transform(list_zip(q.coords, c.coords), lambda t: (t[2]-t[1])*(t[2]-t[1]))) as d2 from kd q, kd c where q.id <> c.id),
n as (select *, row_number() over (partition by id order by d2, nid)::bigint as rank from p) select id, nid, rank, {r6s("d2")} from n where rank <= 5"""
SQL["knn_one_point"] = f"with {EVT}, p as (select id, (x-0.05::double)*(x-0.05::double)+(y-0.5::double)*(y-0.5::double)+(z-0.1::double)*(z-0.1::double) as d2 from cloud) select id, {r6s('d2')} from (select * from p order by d2, id limit 10)"
SQL["range_join_count"] = f"with {EVT}, {near('0.05::double')} select id, count(*) as n from nbr group by id"
SQL["find_point"] = f"""with {FLAT}, t as materialized (select id, x+4e-6::double as x, y, z+case when id%2 = 0 then 0.0 else 0.5 end as z from cloud)
select t.id, min(c.id) as nid from t join cloud c on not ({apart("t", "c")}) group by t.id"""
_BOX = " and ".join(f"{n} between -0.1::double and 0.15::double" for n in "xyz")
SQL["insert_reject_outside"] = f"with {EMB}, new as (select id+1000000 as id, 2*x as x, 2*y as y, 2*z as z from cloud where id%3 = 0) select id, {r6s('x', 'y', 'z')} from (select id, x, y, z from cloud union all select * from new where {_BOX})"
SQL["insert_counts"] = f"with {EMB} select (count(*) filter ({_BOX}))::bigint as inserted, (count(*) filter (not ({_BOX})))::bigint as rejected from cloud"
SQL["erase_points"] = f"with {EMB} select id, {r6s('x', 'y', 'z')} from cloud where id%5 <> 2"
SQL["clear_points"] = "select 0::bigint as size, true as empty"


def _octants(depth: int) -> str:
    parts, source = [], "oct0"
    for level in range(depth):
        mid = {n: f"((lo_{n}+hi_{n})/2)" for n in "xyz"}
        code = "+".join(f"(case when {n} > {mid[n]} then {w} else 0 end)" for n, w in zip("xyz", (4, 2, 1), strict=True))
        box = ", ".join(f"case when {n} > {mid[n]} then {mid[n]} else lo_{n} end as lo_{n}, case when {n} > {mid[n]} then hi_{n} else {mid[n]} end as hi_{n}" for n in "xyz")
        parts.append(f"oct{level + 1} as materialized (select id, x, y, z, path || ({code})::varchar as path, {box} from {source})")
        source = f"oct{level + 1}"
    start = ", ".join(f"-0.5::double as lo_{n}, 0.5::double as hi_{n}" for n in "xyz")
    return f"oct0 as (select id, x, y, z, '' as path, {start} from cloud), " + ", ".join(parts)


_IN_HALF = " and ".join(f"{n} between -0.5 and 0.5" for n in "xyz")
SQL["octant_path"] = f"with {EMB}, {_octants(3)} select id, case when {_IN_HALF} then path end as path from oct3"
_KD = [f"{EMB}, lev0 as materialized (select id, x, y, z, 'r' as path from cloud)"]
for _level, _axis in enumerate("xyz"):
    _KD.append(f"rank{_level} as materialized (select *, row_number() over (partition by path order by {_axis}, id)-1 as rn, count(*) over (partition by path) as n from lev{_level})")
    _KD.append(f"lev{_level + 1} as materialized (select id, x, y, z, path || case when rn < n//2 then '0' else '1' end as path from rank{_level} where rn <> n//2)")
SQL["kd_median_levels"] = f"with {', '.join(_KD)} " + " union all ".join(f"select path, {k}::bigint as depth, '{a}' as axis, id, n::bigint as n from rank{k} where rn = n//2" for k, a in enumerate("xyz"))

SQL["knn_graph_directed"] = f"with {EMB}, {knn(5)} select id as src, nid as dst from nbr"
SQL["knn_graph_undirected"] = f"with {EMB}, {knn(5)} select id as src, nid as dst from nbr union all select nid, id from nbr"
SQL["out_degree"] = f"with {EMB}, {knn(5)}, e as (select id as src, nid as dst from nbr union all select nid, id from nbr) select src, count(*) as edges, sum(dst)::bigint as dst_sum from e group by src"
SQL["graph_counts"] = f"with {EMB}, {knn(5)} select (select count(*) from cloud) as vertex_count, 2*(select count(*) from nbr) as edge_count"
SQL["graph_edit"] = f"with {EMB}, {knn(3)} select id as src, count(*)*(1+(id%2 = 0)::int-(id%3 = 0)::int)::bigint as edges from nbr group by id having (1+(id%2 = 0)::int-(id%3 = 0)::int) > 0"
SQL["bfs_levels"] = f"""with recursive {EMB}, {knn(5)}, walk(level, child) as (select 0::bigint, (select id from cloud order by z desc, id limit 1)
  union select w.level+1, n.nid from walk w join nbr n on n.id = w.child where w.level < 60),
lev as materialized (select child, min(level) as level from walk group by child)
select l.level, min(p.child) as parent, l.child from lev l join nbr n on n.nid = l.child join lev p on p.child = n.id and p.level = l.level-1 where l.level > 0 group by l.level, l.child"""

SQL["normals_knn"] = f"with {EMB}, {knn(10)}, {PLANES} select id, {r6s('l0')}, {r6('abs(vz)', 'abs_nz')}, {r6('l0/(l0+l1+l2)', 'variation')} from nrm"
SQL["tangent_planes"] = f"with {EMB}, {knn(10)}, {PLANES} select id, n, {r6s('ox', 'oy', 'oz')}, {', '.join(r6(f'abs(v{n})', f'abs_n{n}') for n in 'xyz')} from nrm"


def _gauss(s: str, rr: str) -> str:
    return f"exp(-({rr})/(2*{s}*{s}))/({s}*sqrt(2*pi()))"


def _bilateral(source: str, name: str) -> str:
    return f"""{near("2*0.05::double", source, source, f"{name}_n")},
{name}_p as materialized (select n.*, q.nx as mx, q.ny as my, q.nz as mz, p.nx, p.ny, p.nz, (n.x-n.qx)*p.nx+(n.y-n.qy)*p.ny+(n.z-n.qz)*p.nz as t from {name}_n n join {source} q on q.id = n.id join {source} p on p.id = n.nid),
{name}_w as materialized (select *, qx+t*nx as tx, qy+t*ny as ty, qz+t*nz as tz, {_gauss("0.05::double", "d2")}*{_gauss("0.02::double", "(t*nx)*(t*nx)+(t*ny)*(t*ny)+(t*nz)*(t*nz)")} as w from {name}_p),
{name} as materialized (select id, sum(w*tx)/sum(w) as x, sum(w*ty)/sum(w) as y, sum(w*tz)/sum(w) as z, any_value(mx) as nx, any_value(my) as ny, any_value(mz) as nz from {name}_w group by id)"""


SQL["bilateral_points"] = f"with {EMB}, {_bilateral('cloud', 'b1')} select id, {r6s('x', 'y', 'z')} from b1"
SQL["bilateral_points_twice"] = f"with {EMB}, {_bilateral('cloud', 'b1')}, {_bilateral('b1', 'b2')} select id, {r6s('x', 'y', 'z')} from b2"


def _bilateral_normals(head: str = "with " + EMB, cloud: str = "cloud", sf: str = "0.05::double", sg: str = "0.02::double") -> str:
    jac = {a + b: (f"(1-n{a}*n{b})" if a == b else f"(n{a}*n{b})") for a in "xyz" for b in "xyz"}
    gg = {b: f"hg*(ex*{jac['x' + b]}+ey*{jac['y' + b]}+ez*{jac['z' + b]}-e{b})" for b in "xyz"}
    grads = ", ".join(f"d{b}*hf*wg+wf*({gg[b]}) as g{b}" for b in "xyz")
    sums = ", ".join([f"sum(wf*wg*t{a}) as u{a}" for a in "xyz"] + [f"sum(g{b}) as g{b}" for b in "xyz"] + [f"sum({jac[a + b]}*wf*wg+e{a}*g{b}) as j{a}{b}" for a in "xyz" for b in "xyz"])
    rows = ", ".join("+".join(f"(j{a}{b}*k-u{a}*g{b})/(k*k)*m{b}" for b in "xyz") + f" as r{a}" for a in "xyz")
    return f"""{head}, {near(f"2*{sf}", cloud, cloud, "pair")},
p as materialized (select n.*, q.nx as mx, q.ny as my, q.nz as mz, p.nx, p.ny, p.nz, (n.x-n.qx)*p.nx+(n.y-n.qy)*p.ny+(n.z-n.qz)*p.nz as t from pair n join {cloud} q on q.id = n.id join {cloud} p on p.id = n.nid),
e as materialized (select *, qx-x as dx, qy-y as dy, qz-z as dz, t*nx as ex, t*ny as ey, t*nz as ez, qx+t*nx as tx, qy+t*ny as ty, qz+t*nz as tz, sqrt(d2) as rf, sqrt((t*nx)*(t*nx)+(t*ny)*(t*ny)+(t*nz)*(t*nz)) as rg from p),
w as materialized (select *, {_gauss(sf, "rf*rf")} as wf, {_gauss(sg, "rg*rg")} as wg,
  case when rf > 0 then -exp(-rf*rf/(2*{sf}*{sf}))/({sf}*{sf}*{sf}*sqrt(2*pi())) else 0 end as hf, case when rg > 0 then -exp(-rg*rg/(2*{sg}*{sg}))/({sg}*{sg}*{sg}*sqrt(2*pi())) else 0 end as hg from e),
g as materialized (select *, {grads} from w),
s as materialized (select id, any_value(mx) as mx, any_value(my) as my, any_value(mz) as mz, sum(wf*wg) as k, {sums} from g group by id),
r as (select id, {rows} from s) select id, {", ".join(r6(f"r{n}/sqrt(rx*rx+ry*ry+rz*rz)", f"n{n}") for n in "xyz")} from r"""


SQL["bilateral_normals"] = _bilateral_normals()
SQL["random_sample"] = f"with {EMB} select id from cloud order by md5(concat(id, '-7')), id limit 100"


def _wlop(uniform: bool, h: str = "0.15::double", head: str = "with " + EMB, rounds: int = 10) -> str:
    t = lambda d: f"exp(-({d})/({h}*{h}/16))"
    far = apart("q", "c", "1e-9")
    w = lambda c, name: f"{name} as materialized (select c.id, {'1+coalesce(s, 0)' if uniform else '1.0::double'} as w from {c} c left join (select q.id, sum({t(d2('q', 'c'))}) as s from {c} q, {c} c where {d2('q', 'c')} <= {h}*{h} and {far} group by q.id) k on k.id = c.id)"
    parts = [f"{head}, q0 as materialized (select id, x, y, z from cloud order by md5(concat(id, '-7')), id limit 100), {w('cloud', 'v')}"]
    for n in range(rounds):
        q = f"q{n}"
        parts.append(f"""{w(q, f"w{n}")}, {near(h, q, "cloud", f"pq{n}", far)}, {near(h, q, q, f"qq{n}", far)},
med{n} as materialized (select p.id, sum({t("d2")}/sqrt(d2)/v.w) as s, {", ".join(f"sum({t('d2')}/sqrt(d2)/v.w*{a}) as p{a}" for a in "xyz")} from pq{n} p join v on v.id = p.nid group by p.id),
rep{n} as materialized (select p.id, sum(w.w*{t("d2")}/sqrt(d2)) as k, {", ".join(f"sum(w.w*{t('d2')}/sqrt(d2)*(q{a}-{a})) as f{a}" for a in "xyz")} from qq{n} p join w{n} w on w.id = p.nid group by p.id),
q{n + 1} as materialized (select {q}.id, {", ".join(f"(case when coalesce(s, 0) < 1e-9 then {q}.{a} else p{a}/s end)+(case when coalesce(k, 0) < 1e-9 then 0 else 0.45::double/k*f{a} end) as {a}" for a in "xyz")} from {q} left join med{n} m on m.id = {q}.id left join rep{n} r on r.id = {q}.id)""")
    return ", ".join(parts) + f" select id, {r6s('x', 'y', 'z')} from q{rounds}"


SQL["wlop"] = _wlop(True)
SQL["lop"] = _wlop(False)


def _nets(low: tuple[float, ...], high: tuple[float, ...], cells: tuple[int, ...], f: str) -> str:
    """Lattice, crossed edges, and active cells with dense ids."""
    step = [(b - a) / n for a, b, n in zip(low, high, cells, strict=True)]
    base = [a - s for a, s in zip(low, step, strict=True)]
    sx, sy, sz = (n + 2 for n in cells)
    w, h = sx + 1, sy + 1
    x, y, z = (f"({b!r}::double+{n}*{s!r}::double)" for b, s, n in zip(base, step, "ijk", strict=True))
    stride = (1, w, w * h)
    edges = " union all ".join(f"select a.p, a.i, a.j, a.k, {ax} as axis, a.v as a, b.v as b from lat a join lat b on b.p = a.p+{stride[ax]} where a.{n} < {s}" for ax, n, s in ((0, "i", sx), (1, "j", sy), (2, "k", sz)))
    around = []
    for ax in range(3):
        m, n = (q for q in range(3) if q != ax)
        for u in (0, 1):
            for v in (0, 1):
                back = [0, 0, 0]
                back[m], back[n] = u, v
                at = [f"{q}{'+t' if k == ax else ''}" for k, q in enumerate("ijk")]
                around.append(f"select i-{back[0]} as i, j-{back[1]} as j, k-{back[2]} as k, {at[0]} as ui, {at[1]} as uj, {at[2]} as uk from crossed where axis = {ax}")
    world = [f"({b!r}::double+avg(u{n})*{s!r}::double)" for b, s, n in zip(base, step, "ijk", strict=True)]
    return f"""ijk as materialized (select range as p, (range%{w})::bigint as i, ((range//{w})%{h})::bigint as j, (range//{w * h})::bigint as k from range({w * h * (sz + 1)})),
lat as materialized (select p, i, j, k, {f.format(x=x, y=y, z=z)} as v from ijk),
edge as materialized ({edges}),
crossed as materialized (select *, (0-a)/(b-a) as t from edge where (a >= 0) <> (b >= 0)),
touch as materialized ({" union all ".join(around)}),
cell as materialized (select i+j*{w}+k*{w * h} as c, i, j, k, {world[0]} as x, {world[1]} as y, {world[2]} as z from touch
  where i >= 0 and j >= 0 and k >= 0 and i < {sx} and j < {sy} and k < {sz} group by i, j, k),
vert as materialized (select row_number() over (order by c)-1 as vid, * from cell)"""


def _union(radius: str, cloud: str = "cloud") -> str:
    """Distance to the nearest point less a radius."""
    return f"sqrt((select min((c.x-{{x}})*(c.x-{{x}})+(c.y-{{y}})*(c.y-{{y}})+(c.z-{{z}})*(c.z-{{z}})) from {cloud} c))-{radius}::double"


_BALL = EMB + ", " + _nets((-0.6,) * 3, (0.6,) * 3, (12, 12, 12), _union("0.1"))
SQL["surface_nets_sphere_vertices"] = f"with {_BALL} select vid::bigint as vid, {r6s('x', 'y', 'z')} from vert"


def _triangles(w: int, h: int) -> str:
    s = (1, w, w * h)
    quads = " union all ".join(
        f"select v.vid as v0, v1.vid as v1, v2.vid as v2, v3.vid as v3, (e.b > e.a) <> {str(flip).lower()} as fwd from vert v join crossed e on e.p = v.c and e.axis = {ax} join vert v1 on v1.c = v.c-{s[m]} join vert v2 on v2.c = v.c-{s[m] + s[n]} join vert v3 on v3.c = v.c-{s[n]} where v.i > 0 and v.j > 0 and v.k > 0"
        for ax, m, n, flip in ((2, 0, 1, False), (1, 0, 2, True), (0, 1, 2, False))
    )
    return f"""quad as materialized ({quads}), ring as (select v0, case when fwd then v1 else v3 end as a, v2 as b, case when fwd then v3 else v1 end as c from quad)
select v0::bigint as v0, a::bigint as v1, b::bigint as v2 from ring union all select v0, b, c from ring"""


SQL["surface_nets_sphere_triangles"] = f"with {_BALL}, {_triangles(15, 15)}"
SQL["mesh_ply_roundtrip"] = SQL["surface_nets_sphere_triangles"]
_APART = f"{EMB}, two as materialized (select id, x+case when id%2 = 0 then -1.6::double else 1.6::double end as x, y, z from cloud), "
_PAIR_NETS = _APART + _nets((-3.0, -1.0, -1.0), (3.0, 1.0, 1.0), (24, 8, 8), _union("0.3", "two")).replace("vert as materialized (select row_number() over (order by c)-1 as vid, * from cell)", "vert as materialized (select row_number() over (order by c)-1 as vid, * from cell where x < 0)")
SQL["surface_nets_hint"] = f"with {_PAIR_NETS} select vid::bigint as vid, {r6s('x', 'y', 'z')} from vert"

SQL["surface_hint_followed"] = SQL["surface_nets_hint"]


def _reached(low: float, step: float, w: int, h: int) -> str:
    """Active cells in chains of crossed edges from those that hold a point, with dense ids."""
    s = (1, w, w * h)
    sides = " union all ".join(f"select p, axis, p-{u * s[m]}-{v * s[n]} as c from crossed where axis = {ax}" for ax, m, n in ((0, 1, 2), (1, 0, 2), (2, 0, 1)) for u in (0, 1) for v in (0, 1))
    home = "+".join(f"floor(({n}-({low!r}::double))/{step!r}::double)::bigint*{q}" for n, q in zip("xyz", s, strict=True))
    return f"""side as materialized (select t.* from ({sides}) t semi join cell on cell.c = t.c), link as materialized (select distinct a.c as a, b.c as b from side a join side b on b.p = a.p and b.axis = a.axis),
home as materialized (select distinct {home} as c from cloud), root as materialized (select home.c from home semi join cell on cell.c = home.c),
reach as (select c from root union select link.b from reach join link on link.a = reach.c),
vert as materialized (select row_number() over (order by c)-1 as vid, * from cell where c in (select c from reach))"""


SQL["surface_near_samples"] = f"with recursive {_BALL.rsplit('vert as', 1)[0]}{_reached(-0.6 - 1.2 / 12, 1.2 / 12, 15, 15)}, {_triangles(15, 15)}"

_SMALL = EMB + ", " + _nets((-0.6,) * 3, (0.6,) * 3, (5, 5, 5), _union("0.25"))
_CORNER = "(select range%2 as oi, (range//2)%2 as oj, range//4 as ok from range(8))"
SQL["voxel_activity"] = f"""with {_SMALL}, box as materialized (select p, i, j, k from lat where i < 7 and j < 7 and k < 7),
corner as materialized (select b.p as c, b.i, b.j, b.k, o.oi, o.oj, o.ok, b.p+o.oi+o.oj*8+o.ok*64 as q from box b, {_CORNER} o), cv as materialized (select c.*, l.v from corner c join lat l on l.p = c.q),
n as materialized (select a.c, count(*) filter ((a.v >= 0) <> (b.v >= 0)) as crossed from cv a join cv b on b.c = a.c and b.oi+b.oj+b.ok = a.oi+a.oj+a.ok+1 and abs(b.oi-a.oi)+abs(b.oj-a.oj)+abs(b.ok-a.ok) = 1 group by a.c),
m as (select c, i, j, k, min(v) as lo, max(v) as hi from cv group by c, i, j, k)
select m.i::bigint as i, m.j::bigint as j, m.k::bigint as k, n.crossed::bigint as crossed, n.crossed > 0 as active, {r6("lo", "least")}, {r6("hi", "most")} from m join n on n.c = m.c"""

SQL["density_filter"] = f"with {MEANS}, r as materialized (select avg(m) as r from m), n as (select q.id, count(*) as n from cloud q, cloud c, r where {d2('q', 'c')} <= r.r*r.r group by q.id) select id, n from n where n >= 5"
SQL["density_and_normals"] = f"""with {EMB}, {knn(15)}, {PLANES}, {near("0.1::double", name="ball")}, den as (select id, count(*)/{4 / 3 * math.pi * 0.1**3!r}::double as d from ball group by id)
select den.id, round(d, 3)+0.0 as density, {r6("abs(vz)", "abs_nz")} from den left join nrm on nrm.id = den.id"""
SQL["reconstruct_distances"] = f"""with {EMB}, {knn(15)}, {PLANES}, box as materialized (select {", ".join(f"min({n})-(max({n})-min({n}))/20 as {n}0, (max({n})-min({n}))/20 as d{n}" for n in "xyz")} from cloud),
lat as materialized (select range as id, x0+(range%23)*dx as x, y0+((range//23)%23)*dy as y, z0+(range//529)*dz as z from range(12167), box), {knn(1, "lat", "cloud", "one")}
select one.id as p, {r6("case when nid = (select id from cloud order by z desc, id limit 1) then abs(l.z-oz) else abs((l.x-ox)*vx+(l.y-oy)*vy+(l.z-oz)*vz) end", "distance")} from one join lat l on l.id = one.id join nrm on nrm.id = one.nid"""
_SPREAD = "count(*) as n, avg(m) as mean, var_pop(m)*count(*) as sum_sq_dev, var_pop(m) as var_pop"
SQL["downsample_spread"] = f"""with {EMB}, {knn(5)}, part2 as materialized (select * from cloud order by md5(concat(id, '-7')), id limit 200), {knn(5, "part2", "part2", "nbr2")},
m1 as (select avg(sqrt(d2)) as m from nbr group by id), m2 as (select avg(sqrt(d2)) as m from nbr2 group by id), s as (select 'before' as stage, {_SPREAD} from m1 union all select 'after', {_SPREAD} from m2)
select stage, n, {r6s("mean", "sum_sq_dev", "var_pop")} from s"""
SQL["ply_roundtrip"] = f"with {EMB} select row_number() over (order by id)::bigint-1 as id, {', '.join(r6(f'{n}::float::double', n) for n in ('x', 'y', 'z', 'nx', 'ny', 'nz'))} from cloud"
SQL["ply_ascii_roundtrip"] = f"with {PART} select row_number() over (order by id)::bigint-1 as id, {r6s('x', 'y', 'z')}, true as bare from cloud"
SQL["obj_roundtrip"] = f"with {EMB} select row_number() over (order by id)::bigint-1 as id, {r6s('x', 'y', 'z', 'nx', 'ny', 'nz')} from cloud"
SQL["tokenize_words"] = "with w as (select unnest(string_split(p_name, ' ')) as word from part) select word, count(*) as n from w where word <> '' group by word"

# Depth-first: the path from the root as a list, one step down or back a row.
SQL["dfs_order"] = f"""with recursive {EMB}, {knn(5)}, adj as materialized (select id, list(nid order by nid) as ns from nbr group by id),
root as (select id from cloud order by z desc, id limit 1),
walk(step, path, seen, parent, child) as (
  select 0, [id], [id], null::bigint, null::bigint from root
  union all
  select step+1, case when v is null then path[:-2] else list_append(path, v) end, case when v is null then seen else list_append(seen, v) end, case when v is not null then path[-1] end, v
  from (select w.*, list_filter(a.ns, lambda x: not list_contains(w.seen, x))[1] as v from walk w left join adj a on a.id = w.path[-1] where len(w.path) > 0))
select (row_number() over (order by step)-1)::bigint as ord, parent, child from walk where child is not null"""

# Kruskal: edges by weight, one a row, with the component of every vertex in a list.
_KRUSKAL = f"""{EMB}, {knn(5)}, vert as materialized (select id, row_number() over (order by id) as i from cloud),
edge as materialized (select row_number() over (order by w, a, b) as e, a, b, w, va.i as ia, vb.i as ib
  from (select least(id, nid) as a, greatest(id, nid) as b, min(sqrt(d2)) as w from nbr group by 1, 2) join vert va on va.id = a join vert vb on vb.id = b),
pick(e, comp, a, b, w) as (
  select 0::bigint, (select list(i order by i) from vert), null::bigint, null::bigint, null::double
  union all
  select p.e+1, case when ca = cb then comp else list_transform(comp, lambda c: case when c = cb then ca else c end) end, case when ca <> cb then na end, case when ca <> cb then nb end, case when ca <> cb then nw end
  from (select p.e, p.comp, p.comp[n.ia] as ca, p.comp[n.ib] as cb, n.a as na, n.b as nb, n.w as nw from pick p join edge n on n.e = p.e+1) p)"""
SQL["mst_edges"] = f"with recursive {_KRUSKAL} select a, b, {r6s('w')} from pick where a is not null"
SQL["mst_rooted"] = f"""with recursive {_KRUSKAL}, tree as materialized (select a as src, b as dst from pick where a is not null union all select b, a from pick where a is not null),
walk(level, parent, child) as (select 0::bigint, null::bigint, (select id from cloud order by z desc, id limit 1)
  union all select w.level+1, w.child, t.dst from walk w join tree t on t.src = w.child where t.dst is distinct from w.parent)
select level, parent, child from walk where level > 0"""

_UNIFORM = lambda axis, part: f"((('0x' || substr(md5(concat_ws('-', id, {axis}, {part}, 3)), 1, 13))::bigint)::double+0.5)/4503599627370496.0::double"
SQL["add_noise"] = f"""with {MEANS}, s as (select 0.01::double*var_pop(m)*count(*) as sigma from m)
select id, {", ".join(r6(f"{n}+sigma*sqrt(-2*ln({_UNIFORM(i, 0)}))*cos(2*pi()*{_UNIFORM(i, 1)})", n) for i, n in enumerate("xyz"))} from cloud, s"""

# Orientation: breadth-first parents (least id of the level before), then signs from the root down.
_ORIENTED = f"""{EMB}, {knn(10)}, {PLANES},
root as materialized (select id from cloud order by z desc, id limit 1),
walk(level, child) as (select 0::bigint, (select id from root) union select w.level+1, n.nid from walk w join nbr n on n.id = w.child where w.level < 60),
lev as materialized (select child, min(level) as level from walk group by child),
par as materialized (select l.child, min(p.child) as parent from lev l join nbr n on n.nid = l.child join lev p on p.child = n.id and p.level = l.level-1 where l.level > 0 group by l.child),
turn(id, tx, ty, tz) as (select id, 0.0::double, 0.0::double, 1.0::double from root
  union all select id, s*vx, s*vy, s*vz from (select par.child as id, vx, vy, vz, case when vx*tx+vy*ty+vz*tz < 0 and abs(vx*tx+vy*ty+vz*tz) >= 1e-5 then -1.0::double else 1.0::double end as s from turn join par on par.parent = turn.id join nrm on nrm.id = par.child)),
oriented as materialized (select id, tx as nx, ty as ny, tz as nz from turn union all select id, vx, vy, vz from nrm where id not in (select id from turn))"""
SQL["orient_normals"] = f"with recursive {_ORIENTED} select id, {r6s('nx', 'ny', 'nz')} from oriented"
SQL["smoothed_normals"] = _bilateral_normals(f"with recursive {_ORIENTED}, made as materialized (select c.id, x, y, z, o.nx, o.ny, o.nz from cloud c join oriented o on o.id = c.id), sig as materialized (select avg(m) as s from (select avg(sqrt(d2)) as m from nbr group by id))", "made", "(select s from sig)", "(select s from sig)")
SQL["downsample_wlop"] = _wlop(True, "(select h from wide)", f"with {EMB}, {knn(5)}, wide as materialized (select 8*avg(m) as h from (select avg(sqrt(d2)) as m from nbr group by id))")

# Kept octree: what is left of the events after the inserts and erases; every twentieth event asks, with its own range.
_IN_ONE = " and ".join(f"{n} between 0 and 1" for n in "xyz")
_ASKED = "asked as materialized (select id, x, y, z, [0.5::double, 0.05::double, 0.005::double, 0.0005::double, 0.00005::double][(id//20)%5+1] as r from cloud where id%20 = 0)"
_KEPT = f"{EVT}, {_ASKED}, kept as materialized (select * from (select id, x, y, case when id%4 = 0 then z/2 else z end as z from cloud where id%4 = 0 or id%5 <> 2) where {_IN_ONE})"
_TOTALS = "count(*) as n, min({i}) as first_id, sum({i})::bigint as sum_id"
SQL["octree_kept_knn"] = f"with {_KEPT}, {knn(4, 'asked', 'kept')} select id, nid, rank, {r6s('d2')} from nbr"
SQL["octree_kept_boxes"] = f"with {_KEPT} select q.id as qid, {_TOTALS.format(i='c.id')} from asked q join kept c on {' and '.join(f'c.{n} between q.{n}-q.r and q.{n}+q.r' for n in 'xyz')} group by q.id"
SQL["octree_kept_balls"] = f"with {_KEPT} select q.id as qid, {_TOTALS.format(i='c.id')} from asked q join kept c on {d2('q', 'c')} <= q.r*q.r group by q.id"
SQL["sized_range_join"] = f"with {EVT}, {_ASKED} select q.id, {_TOTALS.format(i='c.id')} from asked q join cloud c on {d2('q', 'c')} <= q.r*q.r group by q.id"
SQL["kd_tree_balls"] = SQL["sized_range_join"].replace("select q.id, ", "select q.id as qid, ")
SQL["sized_intersections"] = SQL["intersections"].replace("0.02::double+(id%5)*0.03::double as r", "[0.4::double, 0.04::double, 0.004::double, 0.0004::double, 0.00004::double][id%5+1] as r")
SQL["kd_leaves"] = f"with {', '.join(_KD)} select path, count(*) as n, {', '.join(r6(f'{f}({n})', f'{f}_{n}') for f in ('min', 'max') for n in 'xyz')} from lev3 group by path"
SQL["kd_tree_boxes"] = f"""with {KD} select q.id as qid, c.id from kd q join kd c on q.id%20 = 0 and
list_bool_and(list_transform(list_zip(q.coords, c.coords), lambda t: t[2] >= t[1]-0.36::double and t[2] <= t[1]+0.36::double))"""
