"""SQL (DuckDB) for the registered queries, written apart from the DataFrame code over the raw tables."""

from __future__ import annotations

from curvetrail.config import Gate
from curvetrail.functions.signals import orthogonal_rows

D = "::DOUBLE"
VIEWS: dict[str, tuple[list[str], str]] = {}
ORACLES: dict[str, str] = {}


def view(name: str, needs: str, sql: str) -> None:
    VIEWS[name] = (needs.split(), sql)


def chain(needs: str, instead: dict[str, str] | None = None) -> str:
    """WITH and the views in order of need; instead: other definitions for some of them, which need nothing."""
    order: list[str] = []

    def visit(v: str) -> None:
        if not (instead and v in instead):
            for n in VIEWS[v][0]:
                visit(n)
        if v not in order:
            order.append(v)

    for n in needs.split():
        visit(n)
    text = lambda v: instead[v] if instead and v in instead else VIEWS[v][1]
    return "WITH RECURSIVE " + ",\n".join(f"{v} AS ({text(v)})" for v in order) + "\n" if order else ""


def oracle(name: str, needs: str, sql: str) -> None:
    ORACLES[name] = chain(needs) + sql


def r(x: str) -> str:
    return f"(round(({x})::DOUBLE + 1e-9::DOUBLE, 6) + 0.0::DOUBLE)"


def iou(a: str, b: str, floor: bool = False) -> str:
    ax, bx = [f"{a}{c}" for c in ("x1", "y1", "x2", "y2")], [f"{b}{c}" for c in ("x1", "y1", "x2", "y2")]
    inter = f"(greatest(0, least({ax[2]},{bx[2]})-greatest({ax[0]},{bx[0]}))*greatest(0, least({ax[3]},{bx[3]})-greatest({ax[1]},{bx[1]})))"
    size = lambda x: f"(greatest(0,{x[2]}-{x[0]})*greatest(0,{x[3]}-{x[1]}))"
    union = f"({size(ax)}+{size(bx)}-{inter})"
    return f"({inter}/greatest(1e-6{D},{union}))" if floor else f"({inter}/({union}+1e-6{D}))"


def iiou(s1: str, e1: str, s2: str, e2: str) -> str:
    i = f"greatest(0, least({e1},{e2})-greatest({s1},{s2})+1)"
    return f"({i}/greatest(1, ({e1}-{s1}+1)+({e2}-{s2}+1)-{i})::DOUBLE)"


def top3(list_expr: str) -> str:
    return f"coalesce(list_avg(list_slice(list_reverse_sort(list_filter({list_expr}, lambda x: x IS NOT NULL)), 1, 3)), 0.0{D})"


def clip(x: str, lo: str, hi: str) -> str:
    return f"least({hi}{D}, greatest({lo}{D}, {x}))"


UNSTABLE = "({p}x1 <= {m} OR {p}y1 <= {m} OR {p}x2 >= 640-{m} OR {p}y2 >= 480-{m})"
MARGIN = f"(800.0{D}*0.03{D})"

view("tracks", "", """
SELECT *, cx-w/2 AS x1, cy-h/2 AS y1, cx+w/2 AS x2, cy+h/2 AS y2, w*h AS area, 640.0::DOUBLE AS frame_w, 480.0::DOUBLE AS frame_h FROM (
SELECT user_id // 15 AS video_id, CAST(seq*2 AS BIGINT) AS frame_id, user_id*100 + seq // 20 AS track_id, user_id % 3 AS cls_id,
  CASE WHEN user_id%15=14 THEN 12.0::DOUBLE ELSE 40.0::DOUBLE + 6*(user_id%5) END AS w,
  CASE WHEN user_id%15=14 THEN 9.0::DOUBLE ELSE 30.0::DOUBLE + 4.5::DOUBLE*(user_id%5) END AS h,
  50.0::DOUBLE + 36*(user_id%15) + ((user_id%7)-3)*0.8::DOUBLE*seq + least(value,150.0::DOUBLE)/6.0::DOUBLE AS cx,
  60.0::DOUBLE + 24*(user_id%15) + ((user_id%4)-1.5::DOUBLE)*0.9::DOUBLE*seq + least(value,150.0::DOUBLE)/9.0::DOUBLE AS cy, value
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events) WHERE seq%20 <> 19 AND value > 1.0)""")
view("frames", "tracks", "SELECT video_id, f // 2 AS idx, f AS frame_id FROM (SELECT video_id, unnest(generate_series(0, max(frame_id), 2)) AS f FROM tracks GROUP BY video_id)")
view("scores", "frames", "SELECT f.video_id, f.idx, f.frame_id, least(1.0::DOUBLE, coalesce(avg(t.value), 0.0::DOUBLE)/200.0::DOUBLE) AS score FROM frames f LEFT JOIN tracks t USING (video_id, frame_id) GROUP BY ALL")
view("gt", "tracks", "SELECT video_id, max(frame_id)+1 AS total_frames, CASE WHEN video_id%4=3 THEN -1 ELSE (video_id*7)%40*2 END AS s, CASE WHEN video_id%4=3 THEN -1 ELSE (video_id*7)%40*2 + 20 + video_id%9 END AS e FROM tracks GROUP BY video_id")
view("ev", "", "SELECT event_id, user_id // 15 AS video_id, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events")
view("bin", "", f"SELECT d.doc_id AS ord, l.quality::BIGINT AS y, round(least(d.n_chars,4000)/4000.0{D} + 1e-9{D}, 2) AS score, d.doc_id%3 AS part FROM labels l JOIN documents d USING (doc_id)")
view("obs", "frames", f"SELECT t.*, f.idx, (x1+x2)*0.5{D} AS px, y1+(y2-y1)*0.6{D} AS py FROM tracks t JOIN frames f USING (video_id, frame_id)")
view("spanv", "frames", "SELECT a.video_id, a.frame_id AS start_frame, b.frame_id AS end_frame FROM frames a JOIN frames b ON a.video_id=b.video_id AND b.idx = a.idx+3+(a.video_id+a.idx)%5 WHERE a.idx%8=0")
view("nspan", "spanv", """
SELECT *, row_number() OVER w AS span_no, greatest(0, coalesce(start_frame - lag(end_frame) OVER w, 0)) AS left_gap,
  greatest(0, coalesce(lead(start_frame) OVER w - end_frame, 0)) AS right_gap FROM spanv WINDOW w AS (PARTITION BY video_id ORDER BY start_frame, end_frame)""")
view("prop", "nspan scores", f"""
SELECT n.*, min(s.idx) AS start_idx, max(s.idx) AS end_idx, arg_max(s.idx, (s.score, -s.idx)) AS peak_idx, arg_max(s.frame_id, (s.score, -s.idx)) AS peak_frame,
  max(s.score) AS eventness_peak, avg(s.score) AS eventness_mean, 0.7{D}*max(s.score)+0.3{D}*avg(s.score) AS prior_score
FROM nspan n JOIN scores s ON s.video_id=n.video_id AND s.frame_id BETWEEN n.start_frame AND n.end_frame GROUP BY ALL""")
view("ans", "ev spanv", f"""
SELECT video_id, event_id%n + 1 + (event_id%n)//4 AS span_no, arg_min(k/80.0{D}, event_id) AS a, arg_min((99-k)/100.0{D}, event_id) AS c
FROM ev JOIN (SELECT video_id, count(*) AS n FROM spanv GROUP BY ALL) USING (video_id) GROUP BY ALL""")
view("fused0", "prop ans", f"""
SELECT p.*, {clip('p.prior_score','0.0','1.0')} AS pr, coalesce({clip('a.c','0.0','1.0')}, 0.0{D}) AS vlm_confidence,
  CASE WHEN coalesce(a.c,0.0{D}) < 0.35{D} THEN {clip('p.prior_score','0.0','1.0')} ELSE {clip('a.a','0.0','1.0')} END AS vlm_score
FROM prop p LEFT JOIN ans a USING (video_id, span_no)""")
view("fused", "fused0", f"SELECT *, {clip(f'(1-vlm_confidence)*pr + vlm_confidence*(CASE WHEN vlm_score>0 THEN vlm_score ELSE pr END)','0.0','1.0')} AS fused_score FROM fused0")

oracle("sample_frames", "tracks", f"""
SELECT video_id, source_fps, frame_id, stride FROM (SELECT video_id, {r('25.0+5*(video_id%3)')} AS source_fps, f AS frame_id,
  greatest(1, round_even(greatest(25.0{D}+5*(video_id%3),1.0{D})/12.0{D}, 0))::BIGINT AS stride
  FROM (SELECT video_id, unnest(generate_series(0, max(frame_id))) AS f FROM tracks GROUP BY video_id)) WHERE frame_id % stride = 0""")
oracle("parse_tracks", "tracks", f"""
SELECT video_id, frame_id, track_id, cls_id, CASE cls_id WHEN 0 THEN 'car' WHEN 1 THEN 'person' ELSE cls_id::VARCHAR END AS cls_name, {r(f'least(1.0{D}, value/200.0{D})')} AS score,
  {r('x1+(x2-x1)/2')} AS cx, {r('y1+(y2-y1)/2')} AS cy, {r('x2-x1')} AS w, {r('y2-y1')} AS h, {r('(x2-x1)*(y2-y1)')} AS area FROM tracks WHERE track_id % 11 <> 0""")
oracle("detection_filter", "tracks", f"SELECT video_id, frame_id, track_id, cls_id, {r(f'least(1.0{D}, value/200.0{D})')} AS score FROM tracks WHERE track_id%11<>0 AND least(1.0{D}, value/200.0{D}) >= 0.2{D} AND cls_id IN (0,1)")
oracle("manifest_parse", "", """
SELECT k+1 AS line_no, CASE kind WHEN 2 THEN 'v' WHEN 3 THEN 'w' ELSE 'x' END || k AS video_id,
  CASE kind WHEN 2 THEN '/data/clips/v' || k || CASE WHEN k%7<>0 AND k%2=0 THEN '.mov' ELSE '' END WHEN 3 THEN '/data/clips/w' || k || '.mp4' ELSE '/abs/x' || k || CASE WHEN k%7<>0 THEN '.webm' ELSE '' END END AS path,
  k%7<>0 AS "exists" FROM (SELECT c_custkey AS k, c_custkey%5 AS kind FROM customer) WHERE kind >= 2""")
oracle("gt_parse", "gt", """
SELECT 'v' || video_id AS video_id, CASE video_id%3 WHEN 0 THEN 'frames/v' || video_id WHEN 1 THEN 'path/v' || video_id || '.mp4' ELSE 'd/v' || video_id END AS frame_source,
  CASE WHEN video_id%3=1 THEN 0 ELSE total_frames END AS total_frames, n AS interval_no,
  CASE WHEN n=1 THEN s WHEN video_id%3=0 THEN 3 ELSE 5 END AS s, CASE WHEN n=1 THEN e WHEN video_id%3=0 THEN 7 ELSE 9 END AS e
FROM gt, (VALUES (1),(2)) v(n) WHERE n=1 OR video_id%3=0 OR (video_id%3=1 AND s>=0)""")
oracle("gt_lookup", "gt", "SELECT 'v' || video_id AS video_id, 1::BIGINT AS interval_no, least(s,e) AS s, greatest(s,e) AS e FROM gt")
oracle("labels_roundtrip", "", """
SELECT 'vid' || k AS video_id, 'vid' || k || CASE k%4 WHEN 2 THEN ' 80' WHEN 3 THEN ' 90 3 9 20 ' || (k+20) ELSE ' 100 1 2' END AS line FROM (SELECT s_suppkey AS k FROM supplier)""")
oracle("sanitize_name", "", "SELECT p_partkey, regexp_replace(trim(p_name), ' ', '_', 'g') || CASE WHEN p_partkey%3=0 THEN '' ELSE '_' || replace(p_brand, '#', '_') END AS safe FROM part")
view("fv", "", """
SELECT 'seq' || (k%10) AS folder, 'seq' || (k%10) || '/' || stem || CASE WHEN k%13=0 THEN '.txt' WHEN k%2=0 THEN '.JPG' ELSE '.png' END AS path, stem, odd, k, k%13=0 AS txt FROM (
SELECT p_partkey AS k, p_partkey%10>=7 AND p_partkey%30<10 AS odd, CASE WHEN p_partkey%10>=7 AND p_partkey%30<10 THEN replace(p_name,' ','-') || '_' || p_partkey || 'b' ELSE 'img_' || p_partkey END AS stem FROM part)""")
oracle("list_pictures", "fv", """
SELECT folder, path, stem, pos, CASE WHEN mixed THEN pos ELSE k END AS frame_id FROM (SELECT *, bool_or(odd) OVER (PARTITION BY folder) AS mixed,
  row_number() OVER (PARTITION BY folder ORDER BY odd, CASE WHEN NOT odd THEN k END, CASE WHEN odd THEN stem END) - 1 AS pos FROM fv WHERE NOT txt)""")
oracle("path_keys", "fv", """
SELECT path, coalesce(TRY_CAST(nullif(regexp_replace(stem,'[^0-9]','','g'),'') AS BIGINT), -1) AS digits_id,
  array_to_string(list_transform(regexp_extract_all(lower(path), '([0-9]+|[^0-9]+)'), lambda x: CASE WHEN regexp_matches(x,'^[0-9]') THEN lpad(x,20,'0') ELSE x END), '') AS "natural",
  CASE WHEN txt THEN 'pictures' ELSE 'video' END AS kind, stem FROM fv""")
oracle("resize_plan", "", f"""
SELECT p_partkey, w, h, CASE WHEN greatest(w,h)<=896 THEN w ELSE greatest(1, round_even(w*(896.0{D}/greatest(w,h)),0))::BIGINT END AS new_w,
  CASE WHEN greatest(w,h)<=896 THEN h ELSE greatest(1, round_even(h*(896.0{D}/greatest(w,h)),0))::BIGINT END AS new_h
FROM (SELECT p_partkey, (p_size*37+5)::BIGINT AS w, p_partkey%53*21+7 AS h FROM part)""")
oracle("resume", "", "SELECT c_custkey AS video_id FROM customer WHERE c_custkey%3<>0 ORDER BY 1 LIMIT 25")
oracle("tracks_by_id", "tracks", f"SELECT video_id, track_id, first_value(cls_id) OVER w AS cls_id, row_number() OVER w - 1 AS pos, frame_id, {r('x1')} AS x1, {r('y1')} AS y1, {r('x2')} AS x2, {r('y2')} AS y2 FROM tracks WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame_id)")
oracle("tracks_json", "tracks", f"SELECT video_id, frame_id, track_id, cls_id, {r('x1')} AS x1, {r('y1')} AS y1, {r('x2')} AS x2, {r('y2')} AS y2 FROM tracks")


def gate_value(i: int) -> str:
    return f"(score*((idx*7+{i}*13+video_id*5)%11)/10.0{D} + CASE WHEN (idx+video_id*3+{i}*7)%41=0 THEN 2.0{D} ELSE 0.0{D} END)"


NAMES = [n for n, _ in Gate().weights]
view("gfeat", "scores", "SELECT video_id, idx AS window_id, " + ", ".join(f"{gate_value(i)} AS {n}" for i, n in enumerate(NAMES)) + " FROM scores")
oracle("subscore_table", "scores", f"""
SELECT f.video_id, f.idx, f.frame_id, {r(f'coalesce(g.v, 0.0{D})')} AS score FROM (SELECT *, max(idx) OVER (PARTITION BY video_id) AS m FROM frames) f
LEFT JOIN (SELECT video_id, idx, {gate_value(2)} AS v FROM scores) g ON g.video_id=f.video_id AND g.idx = greatest(f.idx, 7) AND f.m >= 7""")

# geometry
oracle("track_point", "tracks", f"SELECT video_id, frame_id, track_id, {r('(x1+x2)*0.5')} AS px, {r('y1+(y2-y1)*0.6')} AS py, {r('y2')} AS foot_y, {r(f'sqrt(greatest(area,1.0{D}))')} AS scale FROM tracks")
view("stepv", "tracks", "SELECT * FROM (SELECT *, " + ", ".join(f"lag({c}) OVER w AS p_{c}" for c in ("x1", "y1", "x2", "y2", "area", "frame_id")) + " FROM tracks WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame_id)) WHERE p_x1 IS NOT NULL")
RATIO = f"(greatest(greatest(p_area,1.0{D}),greatest(area,1.0{D}))/least(greatest(p_area,1.0{D}),greatest(area,1.0{D})))"
oracle("box_iou", "stepv", f"SELECT video_id, frame_id, track_id, {r(iou('p_',''))} AS iou, {r(iou('p_','',True))} AS iou_floor, {r(RATIO)} AS area_ratio FROM stepv")
oracle("interval_iou", "spanv gt", f"SELECT video_id, start_frame, end_frame, {r(iiou('s','e','start_frame','end_frame'))} AS iou FROM spanv JOIN gt USING (video_id) WHERE e>=0")
EDGE = "least(least(greatest(px,0),640), 640-least(greatest(px,0),640), least(greatest(py,0),480), 480-least(greatest(py,0),480))"
oracle("edge_unstable", "obs", f"SELECT video_id, frame_id, track_id, {UNSTABLE.format(p='', m=MARGIN)} AS unstable, {r(EDGE)} AS edge, {r(clip(f'({EDGE}/800.0{D}-0.03{D})/(0.18{D}-0.03{D})','0.0','1.0'))} AS far FROM obs")
STEP = f"(sqrt(((x1+x2)*0.5{D}-(p_x1+p_x2)*0.5{D})**2 + ((y1+(y2-y1)*0.6{D})-(p_y1+(p_y2-p_y1)*0.6{D}))**2) / greatest(1.0{D}, 0.5{D}*(sqrt(greatest(p_area,1.0{D}))+sqrt(greatest(area,1.0{D})))))"
oracle("stable_pairs", "stepv", f"""SELECT video_id, track_id, p_frame_id AS prev_frame, frame_id, {r(RATIO)} AS area_ratio, {r(STEP)} AS step_ratio,
 NOT {UNSTABLE.format(p='p_', m=MARGIN)} AND NOT {UNSTABLE.format(p='', m=MARGIN)} AND {RATIO} <= 1.5{D} AND {STEP} <= 1.0{D} AS stable FROM stepv""")
oracle("scalars", "tracks", f"""SELECT video_id, frame_id, track_id, {r(f'1/(1+exp(-least(40.0{D},greatest(-40.0{D},(value-60.0{D})/7.0{D}))))')} AS sigmoid, {r(clip(f'value/90.0{D}-0.2{D}','0.0','1.0'))} AS clip01,
 {r(f'CASE WHEN frame_id%3=2 THEN value/100.0{D} ELSE 0.0{D} END')} AS finite, {r(f'(y1+(y2-y1)*0.6{D})-h*0.6{D}')} AS top, {r(f'(y1+(y2-y1)*0.6{D})+h-h*0.6{D}')} AS bottom, (track_id*37)%255 AS color FROM tracks""")
oracle("crop_box", "tracks", f"""
SELECT video_id, track_id, CASE WHEN bad THEN 0 ELSE x1 END::BIGINT AS crop_x1, CASE WHEN bad THEN 0 ELSE y1 END::BIGINT AS crop_y1, CASE WHEN bad THEN 640 ELSE x2 END::BIGINT AS crop_x2, CASE WHEN bad THEN 480 ELSE y2 END::BIGINT AS crop_y2
FROM (SELECT *, x2<=x1 OR y2<=y1 AS bad FROM (SELECT video_id, track_id, greatest(0, round_even(min(x1)-greatest(12.0{D},0.15{D}*(max(x2)-min(x1)+1)),0)) AS x1, greatest(0, round_even(min(y1)-greatest(12.0{D},0.15{D}*(max(y2)-min(y1)+1)),0)) AS y1,
 least(640, round_even(max(x2)+greatest(12.0{D},0.15{D}*(max(x2)-min(x1)+1)),0)) AS x2, least(480, round_even(max(y2)+greatest(12.0{D},0.15{D}*(max(y2)-min(y1)+1)),0)) AS y2 FROM tracks GROUP BY ALL))""")

# tracks
oracle("tracks_by_id", "tracks", "SELECT video_id, track_id, count(*) AS n_obs, string_agg(frame_id::VARCHAR, ',' ORDER BY frame_id) AS frames FROM tracks GROUP BY ALL")
view("seg", "tracks", """SELECT video_id, track_id, arg_min(cls_id, frame_id) AS cls_id, min(frame_id) AS start_frame, max(frame_id) AS end_frame, count(*) AS n_obs,
 arg_min(x1,frame_id) AS sx1, arg_min(x2,frame_id) AS sx2, arg_min(y2,frame_id) AS sy2, arg_min(area,frame_id) AS sarea, arg_max(x1,frame_id) AS ex1, arg_max(x2,frame_id) AS ex2, arg_max(y2,frame_id) AS ey2, arg_max(area,frame_id) AS earea FROM tracks GROUP BY ALL""")
oracle("track_segments", "seg", f"SELECT video_id, track_id, cls_id, start_frame, end_frame, n_obs, {r('sx1')} AS start_x1, {r('ey2')} AS end_y2 FROM seg")
view("short", "tracks", f"""SELECT *, short AS is_short, short AND (median_area<20 OR median_area/307200.0{D}<0.0005{D}) AS dropped FROM (SELECT video_id, track_id, count(*) AS n_obs, max(frame_id)-min(frame_id)+1 AS span,
 list_sort(list(area))[count(*)//2+1] AS median_area, NOT (count(*)>=6 AND max(frame_id)-min(frame_id)+1>=12) AS short FROM tracks GROUP BY ALL)""")
oracle("short_tracks", "short", f"SELECT video_id, track_id, n_obs, span, {r('median_area')} AS median_area, is_short, dropped FROM short")
view("tailv", "tracks", f"""SELECT video_id, track_id, coalesce(list_sort(list(vx) FILTER (vx IS NOT NULL))[count(vx)//2+1], 0.0{D}) AS vx, coalesce(list_sort(list(vy) FILTER (vy IS NOT NULL))[count(vy)//2+1], 0.0{D}) AS vy FROM (
 SELECT video_id, track_id, row_number() OVER (PARTITION BY video_id, track_id ORDER BY frame_id DESC) AS n, ((x1+x2)*0.5{D}-lag((x1+x2)*0.5{D}) OVER w)/greatest(1, frame_id-lag(frame_id) OVER w) AS vx, (y2-lag(y2) OVER w)/greatest(1, frame_id-lag(frame_id) OVER w) AS vy
 FROM tracks WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame_id)) WHERE n<=3 GROUP BY ALL""")
oracle("tail_velocity", "tailv", f"SELECT video_id, track_id, {r('vx')} AS vx, {r('vy')} AS vy FROM tailv")
STITCH = f"""
SELECT video_id, src, dst, gap, {r('score')} AS score FROM (SELECT *, dist/diag + 0.2{D}*abs(ln(ratio)) AS score FROM (SELECT s.video_id, s.track_id AS src, d.track_id AS dst, d.start_frame-s.end_frame AS gap,
 greatest(sqrt(greatest(s.earea,1.0{D}))/sqrt(greatest(d.sarea,1.0{D})), sqrt(greatest(d.sarea,1.0{D}))/sqrt(greatest(s.earea,1.0{D}))) AS ratio, sqrt(v.vx**2+v.vy**2) AS sn,
 sqrt(((d.sx1+d.sx2)*0.5{D}-(s.ex1+s.ex2)*0.5{D})**2+(d.sy2-s.ey2)**2) AS dn, v.vx*((d.sx1+d.sx2)*0.5{D}-(s.ex1+s.ex2)*0.5{D})+v.vy*(d.sy2-s.ey2) AS dot,
 sqrt(((s.ex1+s.ex2)*0.5{D}+v.vx*(d.start_frame-s.end_frame)-(d.sx1+d.sx2)*0.5{D})**2+(s.ey2+v.vy*(d.start_frame-s.end_frame)-d.sy2)**2) AS dist,
 greatest(1.0{D}, sqrt(greatest(640.0{D},s.ex2,d.sx2)**2+greatest(480.0{D},s.ey2,d.sy2)**2)) AS diag
 FROM seg s JOIN tailv v ON v.video_id=s.video_id AND v.track_id=s.track_id JOIN seg d ON d.video_id=s.video_id AND d.cls_id=s.cls_id AND d.track_id<>s.track_id AND d.start_frame-s.end_frame BETWEEN 1 AND 6))
WHERE ratio<=2.5{D} AND (sn<=1e-4{D} OR dn<=1e-4{D} OR (dot/greatest(1e-6{D},sn*dn)>=-0.1{D} AND greatest((dn/gap)/greatest(1e-6{D},sn), sn/greatest(1e-6{D},dn/gap))<=3.5{D})) AND score <= 0.12{D}*(1+greatest(0,gap-1)*0.25{D})"""
oracle("stitch_candidates", "seg tailv", STITCH)
oracle("apply_id_map", "short", f"""
SELECT video_id, frame_id, new_id AS track_id, {r('cx')} AS cx FROM (SELECT t.*, CASE WHEN t.track_id%5=0 THEN t.track_id WHEN s.dropped THEN -1 WHEN t.track_id%4=1 THEN t.track_id-1 ELSE t.track_id END AS new_id FROM tracks t JOIN short s USING (video_id, track_id)) WHERE new_id<>-1""")

# greedy chains: one step a track in order of start; a source serves once, and a track takes the root of its source
view("cand", "seg tailv short", f"""SELECT o.video_id, o.track_id, o.dropped, o.k, coalesce(list_sort(list({{score: p.score, src: p.src}}) FILTER (p.src IS NOT NULL)), []) AS cs
 FROM (SELECT s.video_id, s.track_id, h.dropped, row_number() OVER (PARTITION BY s.video_id ORDER BY s.start_frame, s.track_id) AS k FROM seg s JOIN short h USING (video_id, track_id)) o
 LEFT JOIN (SELECT p.* FROM ({STITCH.replace(r('score'), 'score')}) p JOIN short a ON a.video_id=p.video_id AND a.track_id=p.src JOIN short b ON b.video_id=p.video_id AND b.track_id=p.dst WHERE NOT a.dropped AND NOT b.dropped) p
 ON p.video_id=o.video_id AND p.dst=o.track_id GROUP BY ALL""")
view("steps", "cand", """SELECT DISTINCT video_id, 0::BIGINT AS k, []::BIGINT[] AS used, []::STRUCT(t BIGINT, r BIGINT)[] AS roots FROM cand
 UNION ALL SELECT video_id, k, CASE WHEN b IS NULL OR dropped THEN used ELSE list_append(used, b.src) END,
  list_append(roots, {t: track_id, r: CASE WHEN dropped THEN -1 WHEN b IS NULL THEN track_id ELSE list_filter(roots, lambda x: x.t = b.src)[1].r END})
 FROM (SELECT s.video_id, c.k, s.used, s.roots, c.track_id, c.dropped, list_filter(c.cs, lambda x: NOT list_contains(s.used, x.src))[1] AS b FROM steps s JOIN cand c ON c.video_id=s.video_id AND c.k=s.k+1)""")
view("idmap", "steps", "SELECT video_id, x.t AS track_id, x.r AS new_id FROM (SELECT video_id, unnest(arg_max(roots, k)) AS x FROM steps GROUP BY video_id)")
oracle("refine_ids", "idmap", "SELECT * FROM idmap")

oracle("box_pairs", "tracks", f"SELECT a.video_id, a.frame_id, a.track_id AS a, b.track_id AS b, {r(iou('a.', 'b.'))} AS iou FROM tracks a JOIN tracks b ON a.video_id=b.video_id AND a.frame_id=b.frame_id AND a.track_id<b.track_id AND least(a.x2,b.x2)>greatest(a.x1,b.x1) AND least(a.y2,b.y2)>greatest(a.y1,b.y1)")
view("cedge", "seg tailv short", f"""SELECT p.video_id, unnest([p.src, p.dst]) AS a, unnest([p.dst, p.src]) AS b FROM ({STITCH}) p
 JOIN short x ON x.video_id=p.video_id AND x.track_id=p.src JOIN short y ON y.video_id=p.video_id AND y.track_id=p.dst WHERE NOT x.dropped AND NOT y.dropped""")
view("creach", "cedge", "SELECT video_id, a AS node, a AS component FROM cedge UNION SELECT c.video_id, e.b, c.component FROM creach c JOIN cedge e ON e.video_id=c.video_id AND e.a=c.node")
oracle("chain_components", "short creach", "SELECT s.video_id, s.track_id, coalesce(min(c.component), s.track_id) AS component FROM short s LEFT JOIN creach c ON c.video_id=s.video_id AND c.node=s.track_id GROUP BY s.video_id, s.track_id")

# windows and motion
oracle("sliding_windows", "frames", "SELECT a.video_id, a.idx AS window_id, a.frame_id AS start_frame, b.frame_id AS end_frame, s AS step FROM frames a JOIN frames b ON a.video_id=b.video_id AND b.idx=a.idx+7, (VALUES (1::BIGINT),(3::BIGINT)) v(s) WHERE a.idx%s=0")
view("memb0", "obs", """SELECT a.video_id, a.idx-7 AS window_id, a.track_id, a.idx AS aidx, a.frame_id AS af, b.idx, b.frame_id, b.px, b.py, b.area, b.x1, b.y1, b.x2, b.y2,
 row_number() OVER (PARTITION BY a.video_id, a.track_id, a.idx ORDER BY b.idx DESC)-1 AS k FROM obs a JOIN obs b ON a.video_id=b.video_id AND a.track_id=b.track_id AND b.idx BETWEEN a.idx-7 AND a.idx WHERE a.idx>=7""")
view("memb", "memb0", "SELECT *, max(CASE WHEN k=1 THEN frame_id END) OVER (PARTITION BY video_id, track_id, aidx) AS pf, lead(frame_id) OVER (PARTITION BY video_id, track_id, aidx ORDER BY k) AS earlier FROM memb0")


def power_sums() -> str:
    out = []
    for tag, t, cond in (("", "(frame_id-af)::DOUBLE", "TRUE"), ("p", "(frame_id-pf)::DOUBLE", "k>=1")):
        out += [f"sum({t}**{p}) FILTER ({cond}) AS {tag}s{p}" for p in range(5)]
        out += [f"sum({c}*{t}**{p}) FILTER ({cond}) AS {tag}{c[1]}b{p}" for c in ("px", "py") for p in range(3)]
    out += [f"max(CASE WHEN k={k} THEN {c} END) AS {c}_{k}" for k in (0, 1) for c in ("frame_id", "px", "py", "area", "x1", "y1", "x2", "y2")]
    return ", ".join(out)


def solve(tag: str, c: str, quad: str) -> str:
    s = [f"{tag}s{i}" for i in range(5)]
    b = [f"{tag}{c}b{i}" for i in range(3)]
    det = f"({s[0]}*({s[2]}*{s[4]}-{s[3]}**2)-{s[1]}*({s[1]}*{s[4]}-{s[2]}*{s[3]})+{s[2]}*({s[1]}*{s[3]}-{s[2]}**2))"
    c0 = f"({b[0]}*({s[2]}*{s[4]}-{s[3]}**2)-{s[1]}*({b[1]}*{s[4]}-{b[2]}*{s[3]})+{s[2]}*({b[1]}*{s[3]}-{b[2]}*{s[2]}))/{det}"
    c1 = f"({s[0]}*({b[1]}*{s[4]}-{b[2]}*{s[3]})-{b[0]}*({s[1]}*{s[4]}-{s[2]}*{s[3]})+{s[2]}*({s[1]}*{b[2]}-{b[1]}*{s[2]}))/{det}"
    c2 = f"({s[0]}*({s[2]}*{b[2]}-{b[1]}*{s[3]})-{s[1]}*({s[1]}*{b[2]}-{b[1]}*{s[2]})+{b[0]}*({s[1]}*{s[3]}-{s[2]}**2))/{det}"
    d1 = f"({s[0]}*{s[2]}-{s[1]}**2)"
    l0, l1 = f"({b[0]}*{s[2]}-{b[1]}*{s[1]})/{d1}", f"({s[0]}*{b[1]}-{s[1]}*{b[0]})/{d1}"
    pick = lambda q, lin: f"CASE WHEN {quad} THEN {q} ELSE {lin} END"
    return f"{pick(c0, l0)} AS {tag}{c}0, {pick(c1, l1)} AS {tag}v{c}, {pick(c2, f'0.0{D}')} AS {tag}q{c}"


view("mg", "memb", f"SELECT video_id, window_id, track_id, count(*) AS n, avg(area) AS ma, arg_max(px,k) AS fpx, arg_max(py,k) AS fpy, list_sort(list(frame_id-earlier) FILTER (earlier IS NOT NULL))[(count(*)-1)//2+1] AS ndt, {power_sums()} FROM memb GROUP BY ALL HAVING count(*)>=3")
view("mf", "mg", f"""SELECT *, {solve('', 'x', 'n=8')}, {solve('', 'y', 'n=8')}, {solve('p', 'x', 'FALSE')}, {solve('p', 'y', 'FALSE')}, (frame_id_0-frame_id_1)::DOUBLE AS dt, greatest(1,ndt)::DOUBLE AS nd, sqrt(greatest(area_0,1.0{D})) AS s_0,
 greatest(1.0{D}, 0.5{D}*(sqrt(greatest(area_0,1.0{D}))+sqrt(greatest(area_1,1.0{D})))) AS ps FROM mg WHERE NOT (n=8 AND sqrt((px_0-fpx)**2+(py_0-fpy)**2)/sqrt(greatest(1.0{D},ma)) < 0.3{D})""")
view("mm", "mf", f"""SELECT *, NOT (x1_0<={MARGIN} OR y1_0<={MARGIN} OR x2_0>=640-{MARGIN} OR y2_0>=480-{MARGIN}) AND NOT (x1_1<={MARGIN} OR y1_1<={MARGIN} OR x2_1>=640-{MARGIN} OR y2_1>=480-{MARGIN})
 AND greatest(area_0,area_1)/least(area_0,area_1)<=1.5{D} AND sqrt((px_0-px_1)**2+(py_0-py_1)**2)/ps<=1.0{D} AS stable, sqrt(vx**2+vy**2) AS n2, sqrt(pvx**2+pvy**2) AS n1,
 x0+vx*nd+qx*nd**2 AS nx, y0+vy*nd+qy*nd**2 AS ny, px0+pvx*dt+pqx*dt**2 AS ex, py0+pvy*dt+pqy*dt**2 AS ey FROM mf""")
view("mo0", "mm", f"""SELECT *, n2*dt/s_0*15 AS speed, nx-(x2_0-x1_0)/2 AS bx1, ny-(y2_0-y1_0)*0.6{D} AS by1, nx+(x2_0-x1_0)/2 AS bx2, ny+(y2_0-y1_0)-(y2_0-y1_0)*0.6{D} AS by2,
 ex-(x2_1-x1_1)/2 AS qx1, ey-(y2_1-y1_1)*0.6{D} AS qy1, ex+(x2_1-x1_1)/2 AS qx2, ey+(y2_1-y1_1)-(y2_1-y1_1)*0.6{D} AS qy2, x1_0 AS ox1, y1_0 AS oy1, x2_0 AS ox2, y2_0 AS oy2,
 abs(n1-n2)*dt/ps / greatest(0.03{D}, 0.5{D}*(n1+n2)*dt/ps) AS st, CASE WHEN least(n1,n2)*dt >= greatest(2.0{D}, 0.03{D}*ps) THEN abs(sin(atan2(vy,vx)-atan2(pvy,pvx))) ELSE 0.0{D} END AS tr, n=8 AND stable AS judged FROM mm""")
view("mo", "mo0", f"""SELECT *, CASE WHEN judged THEN sqrt((px_0-ex)**2+(py_0-ey)**2)/s_0 END AS center_err, CASE WHEN judged THEN 1-{iou('q','o')} END AS iou_err, CASE WHEN judged THEN st END AS speed_turn, CASE WHEN judged THEN tr END AS dir_turn,
 CASE WHEN judged THEN (st>0.5{D} OR tr>0.5{D})::INT::DOUBLE END AS turned FROM mo0""")
oracle("poly_fit", "mo", f"SELECT video_id, window_id, track_id, n, {r('x0')} AS x0, {r('y0')} AS y0, {r('vx')} AS vx, {r('vy')} AS vy FROM mo")
oracle("pred_error", "mo", f"SELECT video_id, window_id, track_id, {r('center_err')} AS center_err, {r('iou_err')} AS iou_err FROM mo WHERE judged")
oracle("turn_rates", "mo", f"SELECT video_id, window_id, track_id, {r('speed_turn')} AS speed_turn, {r('dir_turn')} AS dir_turn, {r('turned')} AS turned FROM mo WHERE judged")
oracle("speeds_mean", "mo", f"SELECT video_id, window_id, {r('avg(speed)')} AS speeds_mean FROM mo GROUP BY ALL")
view("coll", "mo", f"SELECT a.video_id, a.window_id, max({iou('a.b','b.b')}) AS collision_warning FROM mo a JOIN mo b ON a.video_id=b.video_id AND a.window_id=b.window_id AND a.track_id<b.track_id WHERE a.stable AND b.stable GROUP BY ALL")
oracle("collision_warning", "coll", f"SELECT video_id, window_id, {r('collision_warning')} AS collision_warning FROM coll")
view("stat", "memb", f"SELECT video_id, window_id, track_id, sqrt((arg_min(px,k)-arg_max(px,k))**2+(arg_min(py,k)-arg_max(py,k))**2)/sqrt(greatest(1.0{D},avg(area))) AS disp_ratio FROM memb GROUP BY ALL HAVING count(*)=8 AND disp_ratio<0.3{D}")
oracle("static_tracks", "stat", f"SELECT video_id, window_id, track_id, {r('disp_ratio')} AS disp_ratio FROM stat")
view("wins", "frames", "SELECT a.video_id, a.idx AS window_id, a.frame_id AS start_frame, b.frame_id AS end_frame FROM frames a JOIN frames b ON a.video_id=b.video_id AND b.idx=a.idx+7")
view("gone", "obs wins", f"""SELECT w.video_id, w.window_id, o.track_id, o.cls_id, o.idx, o.x1, o.y1, o.x2, o.y2, o.px, o.py, {clip(f'({EDGE}/800.0{D}-0.03{D})/(0.18{D}-0.03{D})','0.0','1.0')} AS far
 FROM wins w JOIN obs o ON o.video_id=w.video_id AND o.idx BETWEEN w.window_id AND w.window_id+6
 WHERE NOT EXISTS (SELECT 1 FROM obs q WHERE q.video_id=o.video_id AND q.track_id=o.track_id AND q.idx BETWEEN o.idx+1 AND least(o.idx+2, w.window_id+7))
 AND (SELECT count(*) FROM obs q WHERE q.video_id=o.video_id AND q.track_id=o.track_id AND q.idx BETWEEN w.window_id AND o.idx)>=3""")
oracle("disappeared", "gone", f"SELECT video_id, window_id, track_id, idx, {r('far')} AS far FROM gone")
view("near", "gone stat", f"""SELECT DISTINCT g.video_id, g.window_id, g.track_id, g.idx FROM gone g JOIN obs q ON q.video_id=g.video_id AND q.cls_id=g.cls_id AND q.track_id<>g.track_id AND q.idx BETWEEN g.idx+1 AND least(g.idx+2, g.window_id+7)
 LEFT JOIN stat s ON s.video_id=g.video_id AND s.window_id=g.window_id AND s.track_id=q.track_id WHERE s.track_id IS NULL AND (sqrt((q.px-g.px)**2+(q.py-g.py)**2)/800.0{D}<=0.06{D} OR {iou('g.','q.')}>=0.05{D})""")
oracle("near_replacement", "near", "SELECT * FROM near")
view("dfar", "near", f"SELECT video_id, window_id, count(*) AS n_far, {top3('list(far)')} AS disappear_far_sum FROM gone ANTI JOIN near USING (video_id, window_id, track_id, idx) WHERE far>0 GROUP BY ALL")
oracle("disappear_far", "dfar", f"SELECT video_id, window_id, n_far, {r('disappear_far_sum')} AS disappear_far_sum FROM dfar")
oracle("topk_mean", "tracks", f"SELECT video_id, frame_id, {r(top3('list(value)'))} AS top3, {r('list_sort(list(value))[count(*)//2+1]')} AS upper FROM tracks GROUP BY ALL")
view("tcount", "wins obs stat", """SELECT w.video_id, w.window_id, count(DISTINCT o.track_id) - count(DISTINCT s.track_id) AS track_count FROM wins w JOIN obs o ON o.video_id=w.video_id AND o.idx BETWEEN w.window_id AND w.window_id+7 LEFT JOIN stat s ON s.video_id=w.video_id AND s.window_id=w.window_id AND s.track_id=o.track_id GROUP BY ALL""")
view("mw", "mo", f"""SELECT video_id, window_id, avg(speed) AS speeds_mean, max(center_err) AS pred_center_max_err, max(iou_err) AS pred_iou_max_err, {top3('list(center_err)')} AS pred_center_sum_err, {top3('list(iou_err)')} AS pred_iou_sum_err,
 max(speed_turn) AS speed_turn_rates_max, {top3('list(speed_turn)')} AS speed_turn_rates_sum, max(dir_turn) AS dir_turn_rates_max, {top3('list(dir_turn)')} AS dir_turn_rates_sum, avg(turned) AS turn_active_ratio FROM mo GROUP BY ALL""")
FEATURES = ["track_count", "speeds_mean", "pred_center_max_err", "pred_iou_max_err", "pred_center_sum_err", "pred_iou_sum_err", "speed_turn_rates_max", "speed_turn_rates_sum", "dir_turn_rates_max", "dir_turn_rates_sum", "turn_active_ratio", "collision_warning", "disappear_far_sum"]
view("feat", "wins tcount mw coll dfar", "SELECT w.*, " + ", ".join(f"coalesce({f}::DOUBLE, 0.0{D}) AS {f}" for f in FEATURES) + " FROM wins w LEFT JOIN tcount USING (video_id, window_id) LEFT JOIN mw USING (video_id, window_id) LEFT JOIN coll USING (video_id, window_id) LEFT JOIN dfar USING (video_id, window_id)")
oracle("track_features", "feat", "SELECT video_id, window_id, start_frame, end_frame, " + ", ".join(f"{r(f)} AS {f}" for f in FEATURES) + " FROM feat")
oracle("raw_trigger", "gfeat", f"SELECT video_id, window_id, {r(' + '.join(f'{w}{D}*{n}' for n, w in Gate().weights if n != 'collision_warning'))} AS raw_trigger FROM gfeat")

# scene and embeddings
view("fcount", "frames", f"SELECT f.video_id, f.idx, f.frame_id, count(t.track_id) AS n, coalesce(sum(t.area)/307200.0{D}, 0.0{D}) AS density FROM frames f LEFT JOIN tracks t USING (video_id, frame_id) GROUP BY ALL")
oracle("scene_counts", "fcount", "SELECT video_id, idx-7 AS window_id, " + ", ".join(f"{r(c)} AS cur_{n}, {r(n + '_m')} AS {n}_mean, {r(n + '_s')} AS {n}_std, {r(c + '-' + n + '_f')} AS {n}_delta" for c, n in (("n", "count"), ("density", "density"))) + " FROM (SELECT *, " + ", ".join(f"avg({c}) OVER w AS {n}_m, stddev_pop({c}) OVER w AS {n}_s, first_value({c}) OVER w AS {n}_f" for c, n in (("n", "count"), ("density", "density"))) + " FROM fcount WINDOW w AS (PARTITION BY video_id ORDER BY idx ROWS 7 PRECEDING)) WHERE idx>=7")
view("cells", "obs", f"""SELECT video_id, idx, cell, sum(v) AS v FROM (SELECT video_id, idx, area/307200.0{D} AS a, least(3,greatest(0,trunc(cy/480.0{D}*4)))::INT*4+least(3,greatest(0,trunc(cx/640.0{D}*4)))::INT AS c FROM obs),
 LATERAL (SELECT unnest([c, c+16, 32, 33]) AS cell, unnest([1.0{D}, a, 1.0{D}, a]) AS v) GROUP BY ALL""")
oracle("layout_embedding", "cells", f"SELECT video_id, idx, cell::BIGINT AS cell, {r(f'v/(sqrt(sum(v*v) OVER (PARTITION BY video_id, idx))+1e-6{D})')} AS value FROM cells")
view("emb", "", "SELECT label, vec_id, embedding::DOUBLE[] AS v, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings")
view("perr0", "emb", f"SELECT label, vec_id, list_sum(list_transform(list_zip(v,p), lambda z: (z[1]-z[2])**2)) AS sq, 1 - list_inner_product(v,p)/((sqrt(list_inner_product(v,v))+1e-6{D})*(sqrt(list_inner_product(p,p))+1e-6{D})) AS co FROM emb WHERE p IS NOT NULL")
view("perr", "perr0", f"SELECT *, sq+co AS cb, coalesce(abs(sq+co-lag(sq+co) OVER (PARTITION BY label ORDER BY vec_id)), 0.0{D}) AS de FROM perr0")
oracle("pair_errors", "perr", f"SELECT label::BIGINT AS label, vec_id, {r('sq')} AS sq_l2, {r('co')} AS cosine, {r('cb')} AS combined, {r('sqrt(sq)')} AS l2, {r('de')} AS delta FROM perr")
view("psig", "perr", f"SELECT e.label, e.vec_id, coalesce(cb, 0.0{D}) AS signal FROM embeddings e LEFT JOIN perr USING (label, vec_id)")
oracle("pair_signal", "psig", f"SELECT label::BIGINT AS label, vec_id, {r('signal')} AS signal FROM psig")


def unit(src: str, key: str, val: str) -> list[tuple[str, str, str]]:
    return [
        (f"{src}_m", src, f"SELECT *, quantile_cont({val},0.5) OVER (PARTITION BY {key}) AS m FROM {src}"),
        (f"{src}_s", f"{src}_m", f"SELECT *, greatest(1e-6{D}, 1.4826{D}*quantile_cont(abs({val}-m),0.5) OVER (PARTITION BY {key})) AS s FROM {src}_m"),
        (f"{src}_z", f"{src}_s", f"SELECT *, greatest(0.0{D}, ({val}-m)/s) AS z FROM {src}_s"),
        (f"{src}_u", f"{src}_z", f"SELECT *, least(1.0{D}, z/greatest(1e-6{D}, quantile_cont(z,0.95) OVER (PARTITION BY {key}))) AS u FROM {src}_z"),
    ]


for v in unit("psig", "label", "signal") + unit("scores", "video_id", "score"):
    view(*v)
oracle("eventness", "psig_u", f"SELECT label::BIGINT AS label, {r('avg(u)')} AS eventness FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY u DESC) AS n, count(*) OVER (PARTITION BY label) AS c FROM psig_u) WHERE n <= greatest(1, ceil(c*0.25{D})) GROUP BY ALL")
view("lay", "cells frames", f"SELECT f.video_id, f.idx, list(coalesce(c.v/(n.nrm+1e-6{D}), 0.0{D}) ORDER BY g.cell) AS v FROM frames f CROSS JOIN (SELECT unnest(range(34)) AS cell) g LEFT JOIN cells c ON c.video_id=f.video_id AND c.idx=f.idx AND c.cell=g.cell LEFT JOIN (SELECT video_id, idx, sqrt(sum(v*v)) AS nrm FROM cells GROUP BY ALL) n ON n.video_id=f.video_id AND n.idx=f.idx GROUP BY ALL")
view("layp", "lay", "SELECT *, lag(v) OVER (PARTITION BY video_id ORDER BY idx) AS p FROM lay")
view("laye", "layp", f"SELECT video_id, idx, list_sum(list_transform(list_zip(v,p), lambda z: (z[1]-z[2])**2)) AS sq, 1 - list_inner_product(v,p)/((sqrt(list_inner_product(v,v))+1e-6{D})*(sqrt(list_inner_product(p,p))+1e-6{D})) AS co FROM layp WHERE p IS NOT NULL")
oracle("layout_change", "laye", f"SELECT video_id, idx, {r('sq')} AS sq_l2, {r('co')} AS cosine, {r('sq+co')} AS combined, {r('sqrt(sq)')} AS l2, {r(f'coalesce(abs(sq+co-lag(sq+co) OVER (PARTITION BY video_id ORDER BY idx)), 0.0{D})')} AS delta FROM laye")

# curves
E3 = "coalesce(lag(score) OVER w, score) AS a, score AS b, coalesce(lead(score) OVER w, score) AS c FROM scores WINDOW w AS (PARTITION BY video_id ORDER BY idx)"
oracle("median_filter", "scores", f"SELECT video_id, idx, {r('list_sort([a,b,c])[2]')} AS value FROM (SELECT video_id, idx, {E3})")
oracle("smooth_edge", "scores", f"SELECT video_id, idx, {r('(a+b+c)/3')} AS value FROM (SELECT video_id, idx, {E3})")
oracle("smooth_zero", "scores", f"SELECT video_id, idx, {r('sum(score) OVER (PARTITION BY video_id ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)/9')} AS value FROM scores")
view("sgn", "scores", "SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM scores")
view("sgw", "sgn", "SELECT a.video_id, a.idx, b.score, b.idx - greatest(5, least(a.idx, a.n-6)) AS t, a.idx - greatest(5, least(a.idx, a.n-6)) AS mid FROM sgn a JOIN sgn b ON a.video_id=b.video_id AND b.idx - greatest(5, least(a.idx, a.n-6)) BETWEEN -5 AND 5 WHERE a.n>=11")
oracle("savgol", "sgw", f"""SELECT video_id, idx, {r(clip('c0+c1*mid+c2*mid*mid','0.0','1.0'))} AS value FROM (SELECT video_id, idx, mid, sum(score*(89-5*t*t))/429.0{D} AS c0, sum(score*t)/110.0{D} AS c1, (sum(score*t*t)-10*sum(score))/858.0{D} AS c2 FROM sgw GROUP BY ALL)""")
oracle("dense_curve", "scores", f"SELECT f.video_id, f.idx, f.frame_id, {r(f'coalesce(s.score*2, 0.0{D})')} AS score FROM (SELECT *, max(idx) OVER (PARTITION BY video_id) AS m FROM frames) f LEFT JOIN scores s ON s.video_id=f.video_id AND s.idx=greatest(f.idx,7) AND f.m>=7")
view("rob", "scores_m", "SELECT video_id, any_value(m) AS med, quantile_cont(abs(score-m),0.5) AS mad FROM scores_m GROUP BY ALL")
oracle("robust_stats", "rob", f"SELECT video_id, {r('med')} AS med, {r('mad')} AS mad, {r('1.4826*mad')} AS sigma FROM rob")
oracle("robust_unit", "scores_u", f"SELECT video_id, idx, {r('u')} AS unit FROM scores_u")
oracle("video_topk", "scores", f"SELECT video_id, {r('avg(score)')} AS topk FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC) AS n, count(*) OVER (PARTITION BY video_id) AS c FROM scores) WHERE n <= greatest(1, ceil(c*0.1{D})) GROUP BY ALL")

# gate
def gate_views(src: str, p: str) -> None:
    rows = " UNION ALL ".join(f"SELECT video_id, window_id, {i} AS ei, '{n}' AS expert, {w}{D} AS w, {n} AS v FROM {src}" for i, (n, w) in enumerate(Gate().weights))
    k = "(PARTITION BY video_id, ei)"
    view(f"{p}l", src, rows)
    view(f"{p}m", f"{p}l", f"SELECT *, quantile_cont(v,0.5) OVER {k} AS med, quantile_cont(v,0.98) OVER {k} AS hi FROM {p}l")
    view(f"{p}d", f"{p}m", f"SELECT *, 1.4826{D}*quantile_cont(abs(v-med),0.5) OVER {k} AS sg FROM {p}m")
    view(f"{p}z", f"{p}d", f"SELECT *, {clip(f'(v-med)/(CASE WHEN sg<1e-6{D} THEN greatest((hi-med)/3,1e-6{D}) ELSE sg END)-1','0.0','8.0')} AS z FROM {p}d")
    view(f"{p}e", f"{p}z", f"SELECT *, list_sort([coalesce(lag(z) OVER w2, z), z, coalesce(lead(z) OVER w2, z)])[2] AS zp FROM {p}z WINDOW w2 AS (PARTITION BY video_id, ei ORDER BY window_id)")
    q = lambda c: f"quantile_cont({c},0.98) OVER {k} AS p98, quantile_cont({c},0.5) OVER {k} AS p50, quantile_cont({c},0.8) OVER {k} AS p80"
    view(f"{p}q", f"{p}e", f"SELECT *, {q('z')} FROM {p}e")
    view(f"{p}k", f"{p}q", f"SELECT video_id, window_id, ei, expert, w, z, zp, sparse, CASE WHEN sparse THEN z ELSE zp END AS s FROM (SELECT *, greatest(0.0{D},p98-p50)>0.5{D} AND greatest(0.0{D},p98-p50)/greatest(greatest(p80-p50,0.0{D}),1e-6{D})>=2 AS sparse FROM {p}q)")
    view(f"{p}r", f"{p}k", f"SELECT *, {q('s')} FROM {p}k")
    view(f"{p}t", f"{p}r", f"SELECT *, greatest(0.0{D},p98-p50) AS prom, greatest(0.0{D},p98-p50)/greatest(greatest(p80-p50,0.0{D}),1e-6{D}) AS dom, s > greatest(0.2{D}, p50+0.5{D}*greatest(0.0{D},p98-p50)) AS act FROM {p}r")
    view(f"{p}g", f"{p}t", f"SELECT video_id, ei, expert, any_value(w) AS w, any_value(sparse) AS sparse, any_value(prom) AS prom, any_value(dom) AS dom, any_value(p98) AS peak, count(*) FILTER (act)/count(*)::DOUBLE AS ar, avg(s) FILTER (act) AS mact FROM {p}t GROUP BY video_id, ei, expert")
    view(f"{p}c", f"{p}g", f"""SELECT *, CASE WHEN prom>0.5{D} AND ar>0 THEN w*prom*(0.5{D}*prom+0.5{D}*mact)*(CASE WHEN sparse THEN greatest(0.2{D},1-0.5{D}*ar) ELSE greatest(0.1{D},1-ar/0.35{D}) END)*{clip(f'prom/greatest(peak,1e-6{D})','0.0','1.0')}*(CASE WHEN sparse THEN least(2.0{D},dom/2) ELSE 1.0{D} END) ELSE 0.0{D} END AS conf FROM {p}g""")
    view(f"{p}x", f"{p}c", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY conf DESC, ei DESC) AS rk FROM {p}c WHERE conf>=0.04{D}) WHERE rk<=3")
    view(f"{p}a", f"{p}k {p}x", f"""SELECT t.video_id, t.window_id, max(t.s) AS allmax, max(t.s) FILTER (x.ei IS NOT NULL) AS e, count(x.ei) AS nx, coalesce(sum(greatest(t.s-0.2{D},0)*t.w) FILTER (x.ei IS NOT NULL),0.0{D}) AS sm,
 coalesce(sum(greatest(t.s-0.2{D},0)*t.w*t.s/8) FILTER (x.ei IS NOT NULL),0.0{D}) AS dt, count(*) FILTER (x.ei IS NOT NULL AND greatest(t.s-0.2{D},0)*t.w>0) AS act FROM {p}k t LEFT JOIN {p}x x ON x.video_id=t.video_id AND x.ei=t.ei GROUP BY ALL""")
    view(f"{p}f", f"{p}a", f"""SELECT *, CASE WHEN nx=0 OR e<0.2{D} THEN 0.0{D} ELSE 1/(1+exp(-{clip(f'6*(e-1.8{D})','-40.0','40.0')}))*(CASE WHEN act<2 AND e<3 THEN 0.3{D} ELSE 1.0{D} END) END AS rho FROM {p}a""")


gate_views("gfeat", "gg")
gate_views("feat", "tg")
oracle("evidence_curves", "gge", f"SELECT video_id, expert, window_id, {r('z')} AS z, {r('zp')} AS z_persist FROM gge")
oracle("expert_confidence", "ggc", f"SELECT video_id, expert, sparse, {r('conf')} AS confidence FROM ggc")
oracle("gate_experts", "ggx", "SELECT video_id, expert, rk AS rank FROM ggx")
oracle("gate_curves", "ggf", f"SELECT video_id, window_id, {r(f'rho*(CASE WHEN nx=0 THEN 0.0{D} ELSE dt/greatest(sm,1e-6{D}) END)')} AS trigger, {r('CASE WHEN nx=0 THEN allmax ELSE e END')} AS evidence, {r('1-rho')} AS null_weight, act AS active_experts FROM ggf")
oracle("trigger_curve", "tgf", f"SELECT video_id, window_id, {r(f'rho*(CASE WHEN nx=0 THEN 0.0{D} ELSE dt/greatest(sm,1e-6{D}) END)')} AS trigger, act AS active_experts FROM tgf")

# boundaries
view("thr", "rob scores", f"SELECT video_id, med AS median, greatest(1e-6{D},1.4826{D}*mad) AS sigma, med+0.85{D}*greatest(1e-6{D},1.4826{D}*mad) AS high, mx AS max_score FROM rob JOIN (SELECT video_id, max(score) AS mx FROM scores GROUP BY ALL) USING (video_id)")
oracle("boundary_thresholds", "thr", f"SELECT video_id, {r('median')} AS median, {r('sigma')} AS sigma, {r('high')} AS high, {r('max_score')} AS max_score FROM thr")
view("lp", "scores", f"SELECT * FROM (SELECT *, score >= coalesce(lag(score) OVER w,'-inf'{D}) AND score >= coalesce(lead(score) OVER w,'-inf'{D}) AS pk FROM scores WINDOW w AS (PARTITION BY video_id ORDER BY idx)) WHERE pk")
oracle("local_peaks", "lp", f"SELECT video_id, idx, frame_id, {r('score')} AS score FROM lp")
view("hp", "lp thr", f"SELECT video_id, idx, frame_id, score FROM lp JOIN thr USING (video_id) WHERE score >= greatest(high, 0.15{D})")
view("fspan", "frames", "SELECT a.video_id, a.idx, min(b.idx) AS start_idx, max(b.idx) AS end_idx, min(b.frame_id) AS start_frame, max(b.frame_id) AS end_frame FROM frames a JOIN frames b ON a.video_id=b.video_id AND b.frame_id BETWEEN a.frame_id-4 AND a.frame_id+8 GROUP BY ALL")
oracle("peak_spans", "hp fspan", f"SELECT video_id, idx, frame_id, {r('score')} AS score, start_idx, end_idx, start_frame, end_frame FROM hp JOIN fspan USING (video_id, idx)")


def keep(items: str, clash: str) -> str:
    """Greedy choice over a list: each item that clashes with none kept before."""
    return f"list_reduce(list_transform({items}, lambda x: [x]), lambda a, x: CASE WHEN len(list_filter(a, lambda k: {clash.replace('X', 'x[1]')})) > 0 THEN a ELSE list_concat(a, x) END)"


view("nms", "hp", f"SELECT video_id, unnest({keep('list({{s: score, idx: idx, frame_id: frame_id}} ORDER BY score DESC, idx)'.replace('{{', '{').replace('}}', '}'), 'abs(k.frame_id - X.frame_id) <= 4')}) AS p FROM hp GROUP BY video_id")
oracle("nms_peaks", "nms", f"SELECT video_id, p.idx AS idx, p.frame_id AS frame_id, {r('p.s')} AS score FROM nms")
CLOSE = "k.a <= X.b + 12 AND X.a <= k.b + 12"
view("gsp", "nms fspan", f"SELECT video_id, {keep('list({s: p.s, idx: p.idx, a: start_frame, b: end_frame, i: start_idx, j: end_idx} ORDER BY p.s DESC, p.idx)', CLOSE)} AS kept FROM nms JOIN fspan f ON f.video_id=nms.video_id AND f.idx=nms.p.idx GROUP BY nms.video_id".replace("SELECT video_id, list_reduce", "SELECT nms.video_id, list_reduce"))
oracle("greedy_spans", "gsp", f"SELECT video_id, p.idx AS peak_idx, p.i AS start_idx, p.j AS end_idx, p.a AS start_frame, p.b AS end_frame, {r('p.s')} AS score FROM (SELECT video_id, unnest(kept) AS p FROM gsp)")
view("anch", "frames", f"""SELECT video_id, idx, frame_id, min(k)::BIGINT AS k FROM (SELECT f.video_id, t.k, arg_min(f.idx, (abs(f.frame_id-t.target), f.idx)) AS idx, arg_min(f.frame_id, (abs(f.frame_id-t.target), f.idx)) AS frame_id
 FROM frames f JOIN (SELECT video_id, k, a+(z-a)*(k/3.0{D}) AS target FROM (SELECT video_id, min(frame_id) AS a, max(frame_id) AS z FROM frames GROUP BY video_id), (VALUES (0),(1),(2),(3)) v(k)) t USING (video_id) GROUP BY ALL) GROUP BY ALL""")
oracle("anchors", "anch", "SELECT video_id, idx, frame_id, k FROM anch")
view("anchs", "anch fspan", "SELECT video_id, start_idx, end_idx, start_frame, end_frame, min(k) AS k FROM anch JOIN fspan USING (video_id, idx) GROUP BY ALL")
view("bsp", "gsp anchs thr", """SELECT a.video_id, coalesce(len(g.kept),0) AS n, list_reduce(list_concat([coalesce(list_transform(g.kept, lambda x: {a: x.a, b: x.b, i: x.i, j: x.j}), [])], list_transform(a.more, lambda x: [x])),
 lambda acc, x: CASE WHEN NOT a.quiet AND len(list_filter(acc, lambda k: k.a <= x[1].b + 12 AND x[1].a <= k.b + 12)) > 0 THEN acc ELSE list_concat(acc, x) END) AS s
 FROM (SELECT video_id, any_value(max_score) < 0.15::DOUBLE AS quiet, list({a: start_frame, b: end_frame, i: start_idx, j: end_idx} ORDER BY k) AS more FROM anchs JOIN thr USING (video_id) GROUP BY video_id) a LEFT JOIN gsp g ON g.video_id=a.video_id""")
oracle("boundary_spans", "bsp", "SELECT video_id, p.i AS start_idx, p.j AS end_idx, p.a AS start_frame, p.b AS end_frame, nth > n AS is_anchor FROM (SELECT video_id, n, unnest(s) AS p, generate_subscripts(s,1) AS nth FROM bsp)")

# spans
oracle("span_gaps", "nspan", "SELECT video_id, start_frame, end_frame, span_no, left_gap, right_gap FROM nspan")
view("mi", "scores", f"SELECT video_id, run, min(idx) AS s, max(idx) AS e FROM (SELECT *, sum(nw) OVER (PARTITION BY video_id ORDER BY idx) AS run FROM (SELECT video_id, idx, CASE WHEN idx-lag(idx) OVER (PARTITION BY video_id ORDER BY idx) <= 2 THEN 0 ELSE 1 END AS nw FROM scores WHERE score>0.25{D})) GROUP BY ALL")
oracle("mask_intervals", "mi", "SELECT video_id, s, e FROM mi WHERE e-s+1>=3")
oracle("span_prior", "prop", f"SELECT video_id, start_frame, end_frame, span_no, left_gap, right_gap, start_idx, end_idx, peak_idx, peak_frame, {r('eventness_peak')} AS eventness_peak, {r('eventness_mean')} AS eventness_mean, {r('prior_score')} AS prior_score FROM prop")
oracle("fuse_scores", "fused", f"SELECT video_id, span_no, {r('vlm_confidence')} AS vlm_confidence, {r('vlm_score')} AS vlm_score, {r('fused_score')} AS fused_score, fused_score>=0.5{D} AS is_positive FROM fused")


def merged(src: str, gap: int, limit: str) -> str:
    cut = f" OR start_frame-lag(end_frame) OVER w > {gap}" if gap > 0 else ""
    grow = lambda c: f"CASE WHEN {c}>0 AND {c}<={gap} THEN {c}//2 ELSE 0 END"
    return f"""SELECT video_id, 'merged.' || grp AS merged_id, greatest(0, arg_min(start_frame,ord)-({grow('arg_min(left_gap,ord)')})) AS start_frame, arg_max(end_frame,ord)+({grow('arg_max(right_gap,ord)')}) AS end_frame,
 arg_max(peak_frame, (fused_score, vlm_score, prior_score, eventness_peak, -ord)) AS peak_frame, count(*) AS n_spans, {r('avg(eventness_mean)')} AS eventness_mean, {r('max(fused_score)')} AS fused_score
FROM (SELECT *, start_frame AS ord, sum(cut) OVER (PARTITION BY video_id ORDER BY start_frame) AS grp FROM (SELECT *, CASE WHEN NOT coalesce(lag(pos) OVER w, FALSE){cut} THEN 1 ELSE 0 END AS cut FROM (SELECT *, {limit} AS pos FROM {src}) WINDOW w AS (PARTITION BY video_id ORDER BY start_frame, end_frame)) WHERE pos) GROUP BY video_id, grp"""


view("mprior", "prop", "SELECT * EXCLUDE (prior_score), prior_score, prior_score AS vlm_score, prior_score AS fused_score FROM prop")
oracle("merge_spans", "mprior", f"SELECT 10::BIGINT AS gap, * FROM ({merged('mprior', 10, f'prior_score>=0.3{D}')}) UNION ALL SELECT 0::BIGINT AS gap, * FROM ({merged('mprior', 0, f'prior_score>=0.3{D}')})")
oracle("run_results", "mprior frames", f"""SELECT f.video_id, n AS num_sampled_frames, greatest(0, n - 7) AS num_windows, coalesce(np, 0) AS num_pred_spans, coalesce(nm, 0) AS num_final_spans, coalesce(ps, '') AS pred_spans, coalesce(ms, '') AS final_spans
FROM (SELECT video_id, count(*) AS n FROM frames GROUP BY 1) f LEFT JOIN (SELECT video_id, count(*) AS np, string_agg(concat_ws('-', start_frame, end_frame, peak_frame), ',' ORDER BY start_frame, end_frame, peak_frame) AS ps FROM prop GROUP BY 1) p ON p.video_id=f.video_id
LEFT JOIN (SELECT video_id, count(*) AS nm, string_agg(concat_ws('-', start_frame, end_frame, peak_frame), ',' ORDER BY start_frame, end_frame, peak_frame) AS ms FROM ({merged('mprior', 10, f'prior_score>=0.3{D}')}) GROUP BY 1) m ON m.video_id=f.video_id""")
oracle("refine_spans", "fused", merged("fused", 10, f"fused_score>=0.3{D}"))
view("mid", "prop", f"SELECT p.video_id, p.start_frame, p.end_frame, p.peak_frame, arg_min(f.frame_id, (abs(f.frame_id-(p.start_frame+p.end_frame)/2.0{D}), f.frame_id)) AS m FROM prop p JOIN frames f ON f.video_id=p.video_id AND f.frame_id BETWEEN p.start_frame AND p.end_frame GROUP BY ALL")
view("kf", "mid", "SELECT *, list_reduce([[start_frame],[m],[peak_frame],[end_frame]], lambda a, x: CASE WHEN list_contains(a, x[1]) THEN a ELSE list_concat(a, x) END) AS ks FROM mid")
oracle("keyframes", "kf", "SELECT video_id, start_frame, array_to_string(ks, ',') AS frames FROM kf")
oracle("keyframe_table", "kf", "SELECT video_id, start_frame, generate_subscripts(ks, 1) - 1 AS pos, unnest(ks) AS frame_id FROM kf")
oracle("keyframe_numbers", "kf", """SELECT video_id, span_no, pos, frame_id FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame_id ORDER BY span_no, pos) AS nth FROM (
 SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY start_frame, end_frame) AS span_no, ks FROM kf) k, LATERAL (SELECT generate_subscripts(k.ks, 1) - 1 AS pos, unnest(k.ks) AS frame_id) x) WHERE nth = 1""")
oracle("select_keyframes", "prop", """SELECT video_id, start_frame, array_to_string(list_sort(list_distinct(CASE WHEN list_contains(p, peak_frame) THEN p ELSE [p[1], p[2], peak_frame, p[4]] END)), ',') AS frames
FROM (SELECT *, [start_frame, start_frame+st, start_frame+2*st, end_frame] AS p FROM (SELECT *, greatest(1, (end_frame-start_frame)//3) AS st FROM prop))""")
oracle("evidence_frames", "kf", "SELECT k.video_id, k.start_frame, k.end_frame, k.pos, k.frame_id, count(t.track_id) AS n_tracks FROM (SELECT video_id, start_frame, end_frame, unnest(ks) AS frame_id, generate_subscripts(ks,1)-1 AS pos FROM kf) k LEFT JOIN tracks t ON t.video_id=k.video_id AND t.frame_id=k.frame_id GROUP BY ALL")
oracle("event_summary", "prop", f"SELECT video_id, 'span.' || span_no AS event_id, start_frame, end_frame, peak_frame, {r('eventness_peak')} AS eventness_peak, {r('eventness_mean')} AS eventness_mean, {r('prior_score')} AS span_prior_score FROM prop")
oracle("prompt_build", "prop", """SELECT video_id, span_no, 'You see the key frames as single pictures in time order from a traffic camera. Facts about the span: {"start_frame":' || start_frame || ',"end_frame":' || end_frame || ',"peak_frame":' || peak_frame || '}. Reply with a JSON object alone: anomaly_score (0 to 1), confidence (0 to 1), reason, evidence_tags.' AS prompt FROM prop""")
US = "CASE WHEN n<=1 THEN array_to_string(list_transform(range({k}), lambda i: 0), ',') ELSE array_to_string(list_transform(range({k}), lambda i: round_even(i*(n-1)/{d}.0::DOUBLE, 0)::BIGINT), ',') END"
oracle("uniform_sample", "", f"SELECT k, n, {US.format(k=4, d=3)} AS four, {US.format(k=7, d=6)} AS seven FROM (SELECT c_custkey AS k, c_custkey%90+1 AS n FROM customer)")

# windows of chunks
def chunks(window: int, step: int, n: int) -> str:
    size = window // n
    return f"SELECT video_id, st//{step} AS window_no, c AS chunk, st+c*{size} AS first_idx, st+c*{size}+{size - 1} AS last_idx FROM (SELECT video_id, unnest(generate_series(0, count(*)-{window}, {step})) AS st FROM frames GROUP BY video_id HAVING count(*)>={window}), (SELECT unnest(range({n})) AS c)"


view("ck", "frames", chunks(20, 15, 3))
oracle("chunk_windows", "frames ck", f"SELECT *, 60::BIGINT AS size FROM ({chunks(60, 45, 4)}) UNION ALL SELECT *, 20::BIGINT AS size FROM ck")
view("cp", "ck frames", f"SELECT f.video_id, f.idx, f.frame_id, coalesce(max(((c.video_id*7+c.window_no*5+c.chunk*3)%11)/10.0{D}), 0.0{D}) AS score, count(c.chunk)>0 AS scored FROM frames f LEFT JOIN ck c ON c.video_id=f.video_id AND f.idx BETWEEN c.first_idx AND c.last_idx GROUP BY ALL")
oracle("chunk_projection", "cp", f"SELECT video_id, idx, frame_id, {r('score')} AS score, scored FROM cp")
oracle("coverage", "ck frames", f"SELECT f.video_id, count(DISTINCT f.idx) AS n_frames, count(DISTINCT CASE WHEN c.chunk IS NOT NULL THEN f.idx END) AS covered, {r('count(DISTINCT CASE WHEN c.chunk IS NOT NULL THEN f.idx END)/count(DISTINCT f.idx)::DOUBLE')} AS ratio FROM frames f LEFT JOIN ck c ON c.video_id=f.video_id AND c.chunk=0 AND f.idx BETWEEN c.first_idx AND c.first_idx+19 GROUP BY ALL")


def intervals(src: str, gap: int, least: int) -> str:
    return f"SELECT video_id, 2*min(idx) AS start_frame, 2*max(idx) AS end_frame FROM (SELECT *, sum(nw) OVER (PARTITION BY video_id ORDER BY idx) AS run FROM (SELECT video_id, idx, CASE WHEN idx-lag(idx) OVER (PARTITION BY video_id ORDER BY idx) <= {gap + 1} THEN 0 ELSE 1 END AS nw FROM {src} WHERE v>0.5{D})) GROUP BY video_id, run HAVING max(idx)-min(idx)+1>={least}"


view("cps", "cp", f"SELECT video_id, idx, {clip('sum(score) OVER (PARTITION BY video_id ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)/9','0.0','1.0')} AS v FROM cp")
oracle("pred_intervals", "cps", intervals("cps", 3, 4))
view("cpn", "cp", "SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM cp")
view("cpw", "cpn", "SELECT a.video_id, a.idx, b.score, b.idx - greatest(5, least(a.idx, a.n-6)) AS t, a.idx - greatest(5, least(a.idx, a.n-6)) AS mid FROM cpn a JOIN cpn b ON a.video_id=b.video_id AND b.idx - greatest(5, least(a.idx, a.n-6)) BETWEEN -5 AND 5")
view("cpv", "cpw", f"SELECT video_id, idx, {clip(f'sum(score*(89-5*t*t))/429.0{D} + sum(score*t)/110.0{D}*mid + (sum(score*t*t)-10*sum(score))/858.0{D}*mid*mid','0.0','1.0')} AS v FROM cpw GROUP BY video_id, idx, mid")
oracle("window_baseline", "cpv", intervals("cpv", 3, 4))

# evaluation
oracle("frame_labels", "gt frames", "SELECT f.video_id, f.idx, f.frame_id, (e>=0 AND f.idx BETWEEN greatest(0,s) AND e)::BIGINT AS y, CASE WHEN d THEN (e>=0)::BIGINT ELSE 1::BIGINT END AS video_y, d AS dropped FROM frames f JOIN gt USING (video_id), (VALUES (TRUE),(FALSE)) v(d)")


def rank_views(src: str, key: str, p: str) -> None:
    view(f"{p}r", src, f"SELECT *, sum((y=1)::INT) OVER w AS tp, sum((y=0)::INT) OVER w AS fp, sum((y=1)::INT) OVER (PARTITION BY {key}) AS pos, sum((y=0)::INT) OVER (PARTITION BY {key}) AS neg FROM {src} WINDOW w AS (PARTITION BY {key} ORDER BY score DESC, ord ROWS UNBOUNDED PRECEDING)")
    view(f"{p}auc", f"{p}r", f"SELECT {key}, CASE WHEN any_value(pos)>0 AND any_value(neg)>0 THEN sum(CASE WHEN y=0 THEN tp ELSE 0 END)/(any_value(pos)*any_value(neg))::DOUBLE END AS auc FROM {p}r GROUP BY ALL")
    view(f"{p}ap", f"{p}r", f"SELECT {key}, CASE WHEN any_value(pos)>0 THEN sum(CASE WHEN y=1 THEN tp/(tp+fp)::DOUBLE ELSE 0 END)/any_value(pos)::DOUBLE END AS ap FROM {p}r GROUP BY ALL")
    view(f"{p}roc", f"{p}r", f"SELECT {key}, max(fp)/any_value(neg)::DOUBLE AS fpr, max(tp)/any_value(pos)::DOUBLE AS tpr, score AS threshold FROM {p}r WHERE pos>0 AND neg>0 GROUP BY {key}, score UNION ALL SELECT DISTINCT {key}, 0.0{D}, 0.0{D}, 'inf'{D} FROM {p}r WHERE pos>0 AND neg>0")
    view(f"{p}eer", f"{p}roc", f"SELECT {key}, (fpr+1-tpr)/2 AS eer, tpr AS edr, threshold AS threshold_at_eer FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY abs(fpr-(1-tpr)), threshold DESC) AS n FROM {p}roc) WHERE n=1")


rank_views("bin", "part", "b")
oracle("roc_auc", "bauc", f"SELECT part, {r('auc')} AS auc FROM bauc")
oracle("avg_precision", "bap", f"SELECT part, {r('ap')} AS ap FROM bap")
oracle("roc_curve", "broc", f"SELECT part, {r('fpr')} AS fpr, {r('tpr')} AS tpr, {r('CASE WHEN threshold>1e9 THEN -1 ELSE threshold END')} AS threshold FROM broc")
oracle("eer", "beer", f"SELECT part, {r('eer')} AS eer, {r('edr')} AS edr, {r('threshold_at_eer')} AS threshold_at_eer FROM beer")
oracle("accuracy_at", "bin", f"SELECT part, {r(f'avg(((score>=0.5{D})::INT = y)::INT)')} AS accuracy FROM bin GROUP BY ALL")
P, R = "coalesce(tp/nullif(tp+fp,0)::DOUBLE,0.0::DOUBLE)", "coalesce(tp/nullif(tp+fn,0)::DOUBLE,0.0::DOUBLE)"
oracle("prf1", "bin", f"SELECT part, sub, tp, fp, fn, {r(P)} AS precision, {r(R)} AS recall, {r(f'coalesce(2*{P}*{R}/nullif({P}+{R},0), 0)')} AS f1 FROM (SELECT part, ord%17 AS sub, count(*) FILTER (score>=0.3{D} AND y=1) AS tp, count(*) FILTER (score>=0.3{D} AND y=0) AS fp, count(*) FILTER (score<0.3{D} AND y=1) AS fn FROM bin GROUP BY ALL)")
view("cov", "gt spanv", f"SELECT g.video_id, g.s, g.e, p.start_frame, p.end_frame, greatest(0, least(g.e,p.end_frame)-greatest(g.s,p.start_frame)+1)/greatest(1,g.e-g.s+1)::DOUBLE AS cover, {iiou('g.s','g.e','p.start_frame','p.end_frame')} AS iou FROM gt g JOIN spanv p USING (video_id) WHERE g.e>=0")
view("best", "cov", f"SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY round(cover,6) DESC, round(iou,9) DESC, start_frame) AS n, max(iou) OVER (PARTITION BY video_id) AS mi FROM cov")
oracle("gt_span_metrics", "best", f"SELECT video_id, 1::BIGINT AS num_gt_intervals, {r('(cover>0)::INT')} AS hit_ratio, {r(f'(cover>=0.8{D})::INT')} AS full80_ratio, {r('cover')} AS mean_best_cover, {r('CASE WHEN cover>0 THEN iou ELSE 0 END')} AS mean_best_iou FROM best WHERE n=1")
oracle("gt_overlap", "best", f"SELECT video_id, s, e, {r('mi')} AS best_iou, mi>0 AS covered FROM best WHERE n=1")
view("labv", "gt scores", "SELECT f.video_id, f.idx, round(f.score, 9) AS score, (e>=0 AND f.idx BETWEEN greatest(0,s) AND e)::BIGINT AS y, (e>=0)::BIGINT AS video_y FROM scores f JOIN gt USING (video_id)")
view("evr", "labv", f"SELECT 'frame' AS level, video_id*1000000+idx AS ord, y, score FROM labv WHERE video_y=1 UNION ALL SELECT 'video', video_id, video_y, avg(score) FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC) AS n, count(*) OVER (PARTITION BY video_id) AS c FROM labv) WHERE n<=greatest(1,ceil(c*0.1{D})) GROUP BY video_id, video_y")
rank_views("evr", "level", "e")
oracle("eval_summary", "eauc eap eeer evr", f"SELECT level, n, positives, {r('auc')} AS auc, {r('ap')} AS ap, {r('eer')} AS eer, {r('edr')} AS edr, {r('threshold_at_eer')} AS threshold_at_eer, {r('accuracy')} AS accuracy FROM (SELECT level, count(*) AS n, sum(y)::BIGINT AS positives, avg(((score>=0.3{D})::INT=y)::INT) AS accuracy FROM evr GROUP BY ALL) LEFT JOIN eauc USING (level) LEFT JOIN eap USING (level) LEFT JOIN eeer USING (level)")
oracle("frame_mismatch", "gt", "SELECT video_id, total_frames+1 AS declared, total_frames AS actual FROM gt WHERE video_id%2=0")
oracle("run_summary", "scores", f"SELECT count(*) AS videos, count(*) FILTER (top>=0.5{D}) AS high, {r('avg(n)')} AS mean_frames, {r('count(*) FILTER (n>=60)/count(*)::DOUBLE')} AS long_share FROM (SELECT video_id, count(*) AS n, max(score) AS top FROM scores GROUP BY ALL)")

# answers
oracle("json_extract", "ev", """SELECT event_id, CASE k%4 WHEN 1 THEN '{"a": ' || k || '}' WHEN 3 THEN '{"a": {"b": ' || k || '}}' END AS body FROM ev""")
oracle("parse_span_score", "ev", f"""SELECT event_id, {r(f"CASE k%5 WHEN 0 THEN least(1.0{D}, k/80.0{D}) WHEN 1 THEN ('0.' || k)::DOUBLE WHEN 2 THEN 0.75{D} ELSE 0.0{D} END")} AS anomaly_score,
 {r(f"CASE k%5 WHEN 0 THEN 0.5{D} WHEN 1 THEN ('0.' || k)::DOUBLE ELSE 0.0{D} END")} AS confidence, CASE k%5 WHEN 0 THEN 'r' || k ELSE '' END AS reason FROM ev""")
view("pcs", "ev", f"SELECT event_id, k, ('0.' || (k%10))::DOUBLE AS d, k%2=0 AS an, CASE k%5 WHEN 0 THEN 'normal' WHEN 1 THEN 'unknown' ELSE 'abnormal_stop' END AS ty, [('0.' || (k%10))::DOUBLE, 1.0{D}, 0.0{D}, CASE WHEN k%3=0 THEN 0.25{D} ELSE 0.0{D} END] AS sc FROM ev")
oracle("parse_chunk_scores", "pcs", f"""SELECT event_id, an AS is_anomaly, {r('CASE WHEN NOT an OR ty=$$normal$$ THEN 1-d ELSE d END')} AS overall_score, array_to_string(list_transform(sc, lambda x: round(100*(CASE WHEN NOT an OR ty='normal' THEN 1-x ELSE x END))::BIGINT), ',') AS chunks, ty AS anomaly_type, '1,2,3' AS abnormal, {r('1')} AS confidence FROM pcs""")
oracle("parse_clip_stage1", "ev", "SELECT event_id, 's' || k AS scene_summary, 'a|b' || k || '||' AS chunks, '2,1' AS likely, TRUE AS noticeable_change, CASE WHEN k%2=0 THEN 'clearly_risky' ELSE 'normal' END AS risk_hint FROM ev")

# calibration
view("free", "obs gt", "SELECT o.* FROM obs o WHERE NOT EXISTS (SELECT 1 FROM gt g WHERE g.video_id=o.video_id AND g.e>=0 AND o.frame_id BETWEEN g.s AND g.e)")
view("fr1", "free", f"""SELECT *, count(*) OVER t AS n, row_number() OVER w AS nth, sqrt((last_value(px) OVER f-first_value(px) OVER f)**2+(last_value(py) OVER f-first_value(py) OVER f)**2)/sqrt(greatest(1.0{D}, avg(area) OVER t)) AS disp,
 sqrt((px-lag(px) OVER w)**2+(py-lag(py) OVER w)**2) AS stp, lag(area) OVER w AS p_area, {EDGE}/800.0{D} AS edge FROM free WINDOW t AS (PARTITION BY video_id, track_id), w AS (PARTITION BY video_id, track_id ORDER BY frame_id), f AS (PARTITION BY video_id, track_id ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
view("fr2", "fr1", f"SELECT *, stp/greatest(1.0{D}, 0.5{D}*(sqrt(greatest(p_area,1.0{D}))+sqrt(greatest(area,1.0{D})))) AS str FROM fr1")
view("fr3", "fr2", "SELECT *, lag(stp) OVER w AS bp, lag(str) OVER w AS br FROM fr2 WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame_id)")
view("cgone", "free", f"""SELECT o.*, {EDGE}/800.0{D} AS edge FROM free o WHERE o.idx < (SELECT max(idx) FROM frames f WHERE f.video_id=o.video_id) AND NOT EXISTS (SELECT 1 FROM free q WHERE q.video_id=o.video_id AND q.track_id=o.track_id AND q.idx BETWEEN o.idx+1 AND o.idx+2)
 AND (SELECT count(*) FROM free q WHERE q.video_id=o.video_id AND q.track_id=o.track_id AND q.idx<=o.idx)>=3 AND NOT EXISTS (SELECT 1 FROM free q WHERE q.video_id=o.video_id AND q.cls_id=o.cls_id AND q.track_id<>o.track_id AND q.idx BETWEEN o.idx+1 AND o.idx+2 AND (sqrt((q.px-o.px)**2+(q.py-o.py)**2)/800.0{D}<=0.06{D} OR {iou('o.','q.',True)}>=0.05{D}))""")
view("cst", "fr3 cgone", f"""SELECT video_id, 'track_disp_ratio' AS stat, disp AS value FROM fr3 WHERE nth=1 AND n>=8 UNION ALL SELECT video_id, 'edge_distance_norm', edge FROM fr3
 UNION ALL SELECT video_id, 'area_ratio', {RATIO} FROM fr3 WHERE nth>1 UNION ALL SELECT video_id, 'step_ratio', str FROM fr3 WHERE nth>1 UNION ALL SELECT video_id, 'step_px', stp FROM fr3 WHERE nth>1
 UNION ALL SELECT video_id, 'low_disp_step_ratio', str FROM fr3 WHERE nth>1 AND n>=3 AND disp<0.5{D} UNION ALL SELECT video_id, 'low_disp_step_px', stp FROM fr3 WHERE nth>1 AND n>=3 AND disp<0.5{D}
 UNION ALL SELECT video_id, 'triplet_min_step_ratio', least(br,str) FROM fr3 WHERE nth>2 UNION ALL SELECT video_id, 'triplet_min_step_px', least(bp,stp) FROM fr3 WHERE nth>2 UNION ALL SELECT video_id, 'disappear_edge_norm', edge FROM cgone""")
oracle("calib_stats", "cst", f"SELECT video_id, stat, count(*) AS n, {r('sum(value)')} AS total, {r('max(value)')} AS top FROM cst GROUP BY ALL")
oracle("calib_percentiles", "cst", "SELECT stat, count(*) AS n, " + ", ".join(f"{r(f'quantile_cont(value,{q / 100})')} AS p{q}" for q in (5, 25, 50, 75, 85, 90, 95, 98, 99)) + " FROM cst GROUP BY ALL")
oracle("calib_recommend", "cst", f"""SELECT parameter, {r('least(hi, greatest(lo, coalesce((SELECT quantile_cont(value, 0.35) FROM cst WHERE stat=s AND q=35), (SELECT quantile_cont(value, 0.85) FROM cst WHERE stat=s AND q=85), (SELECT quantile_cont(value, 0.9) FROM cst WHERE stat=s AND q=90), (SELECT quantile_cont(value, 0.98) FROM cst WHERE stat=s AND q=98), (SELECT quantile_cont(value, 0.99) FROM cst WHERE stat=s AND q=99), base)))')} AS value
 FROM (VALUES ('STATIC_MOVE_RATIO','track_disp_ratio',35,0.15,0.10,0.30),('DISAPPEAR_FAR_EDGE_RATIO','disappear_edge_norm',90,0.18,0.15,0.25),('MIN_TURN_SPEED_RATIO','low_disp_step_ratio',90,0.05,0.03,0.10),('MIN_DIR_MOTION_RATIO','low_disp_step_ratio',85,0.04,0.03,0.10),('MIN_DIR_MOTION_PX','low_disp_step_px',90,3.0,2.0,8.0),('MAX_MOTION_AREA_RATIO','area_ratio',99,1.5,1.5,3.0),('MAX_STEP_RATIO','step_ratio',98,1.5,1.0,3.0)) v(parameter,s,q,base,lo,hi)
 UNION ALL SELECT p, x::DOUBLE FROM (VALUES ('DISAPPEAR_LOOKAHEAD',2),('DISAPPEAR_MIN_TRACK_LEN',3),('TURN_CHANGE_RATIO',0.5),('SPEED_SCALING_FACTOR',15),('TOPK_AGG_COUNT',3),('EDGE_UNSTABLE_RATIO',0.03),('REPLACEMENT_CENTER_RATIO',0.06),('REPLACEMENT_IOU',0.05),('TRACK_POINT_Y_RATIO',0.6)) w(p,x)""")

# whole analysis: the views of features, gate and boundaries over repaired tracks
REPAIRED = {
    "tracks": chain("tracks idmap") + "SELECT t.* EXCLUDE (track_id), m.new_id AS track_id FROM tracks t JOIN idmap m USING (video_id, track_id) WHERE m.new_id <> -1",
    "frames": chain("frames") + "SELECT * FROM frames",
}
TRIGGER = chain("tracks frames tgf", REPAIRED) + f"SELECT video_id, window_id, rho*(CASE WHEN nx=0 THEN 0.0{D} ELSE dt/greatest(sm,1e-6{D}) END) AS trigger FROM tgf"
SMOOTH = REPAIRED | {"scores": f"""SELECT video_id, idx, frame_id, (coalesce(lag(v) OVER w, v) + v + coalesce(lead(v) OVER w, v))/3.0{D} AS score FROM (
 SELECT f.video_id, f.idx, f.frame_id, coalesce(t.trigger, 0.0{D}) AS v FROM (SELECT *, max(idx) OVER (PARTITION BY video_id) AS m FROM ({REPAIRED['frames']})) f
 LEFT JOIN ({TRIGGER}) t ON t.video_id=f.video_id AND t.window_id=greatest(f.idx-7, 0) AND f.m>=7) WINDOW w AS (PARTITION BY video_id ORDER BY idx)"""}
ORACLES["analyze"] = chain("tracks frames scores bsp", SMOOTH) + ORACLES["boundary_spans"][ORACLES["boundary_spans"].rindex("\nSELECT video_id, p.i") + 1 :]

# more sources, answers and prompts
oracle("listed_pictures", "fv", """
SELECT 'root/' || folder AS folder, 'root/' || path AS path, stem, pos, CASE WHEN mixed THEN pos ELSE k END AS frame_id FROM (SELECT *, bool_or(odd) OVER (PARTITION BY folder) AS mixed,
  row_number() OVER (PARTITION BY folder ORDER BY odd, CASE WHEN NOT odd THEN k END, CASE WHEN odd THEN stem END) - 1 AS pos FROM fv WHERE NOT txt AND length(path)%2=0)""")
oracle("parse_span_stage1", "ev", "SELECT event_id, CASE WHEN k%3=0 THEN 's' || k ELSE '' END AS scene_summary, CASE WHEN k%3=0 THEN 'car|' || k ELSE '' END AS objects, CASE WHEN k%3=0 THEN 'fast' ELSE '' END AS motion_summary, CASE WHEN k%6=0 THEN 'clearly_abnormal' ELSE 'normal' END AS anomaly_hint, CASE WHEN k%3=0 THEN 'near|' ELSE '' END AS tags FROM ev")
oracle("parse_span_stage2", "ev", f"""SELECT event_id, {r(f"CASE k%3 WHEN 0 THEN least(1.0{D}, k/50.0{D}) WHEN 1 THEN 0.25{D} ELSE 0.0{D} END")} AS anomaly_score, {r(f"CASE k%3 WHEN 0 THEN least(1.0{D}, k/50.0{D}) WHEN 1 THEN 1.0{D} ELSE 0.0{D} END")} AS confidence,
 CASE k%3 WHEN 1 THEN 'why ' || k ELSE '' END AS reason, CASE k%3 WHEN 0 THEN 'a|b' ELSE '' END AS tags FROM ev""")
FACTS = """'{"start_frame":' || start_frame || ',"end_frame":' || end_frame || ',"peak_frame":' || peak_frame || '}'"""
oracle("prompt_stages", "prop", f"""SELECT video_id, span_no, 'You see one picture that tiles the key frames in time order. Describe it without judging. Facts: ' || {FACTS} || '. Reply with a JSON object alone: scene_summary, main_objects, motion_summary, anomaly_hint, evidence_tags.' AS stage1,
 'An observer of key frames with boxes and trails drawn, and a close-up of the main object noted: note ' || span_no || '. Facts: ' || {FACTS} || '. Reply with a JSON object alone: anomaly_score, confidence, reason, evidence_tags.' AS stage2,
 'The pictures are 16 frames of a clip in time order, 4 for each of its 4 parts. Describe each part. Reply with a JSON object alone: main_objects, scene_summary, chunk_descriptions, noticeable_change, likely_abnormal_chunks, risk_hint.' AS clip1,
 'Notes on a clip: note ' || span_no || '. Score each of the 4 parts. Reply with a JSON object alone: is_anomaly, overall_score, chunk_scores, anomaly_type, abnormal_chunks, confidence, short_reason.' AS clip2 FROM prop""")
AXES = orthogonal_rows(64, 4)
oracle("random_projection", "", "SELECT vec_id, " + ", ".join(f"{r('list_inner_product(embedding::DOUBLE[], [' + ','.join(repr(float(x)) + D for x in row) + '])')} AS p{i}" for i, row in enumerate(AXES)) + " FROM embeddings")
