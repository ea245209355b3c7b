"""DuckDB SQL for the checked queries.

Each oracle is written against named views; :func:`sql` prepends the definitions
of the views a text mentions.
"""

from __future__ import annotations

import re

from fleetplan.sources.synthetic import PROFILES

AS_OF = "TIMESTAMP '1998-06-01 00:00:00'"

# View definitions, each using only earlier ones.
VIEWS: dict[str, str] = {}

VIEWS["wf_tasks"] = """
SELECT o_orderkey AS wf_id,
       CONCAT('ns-', CAST(o_custkey % 5 AS STRING)) AS namespace,
       CONCAT('wf-', CAST(o_orderkey AS STRING)) AS workflow_name,
       idx, CONCAT('t', CAST(idx AS STRING)) AS task_name, p_brand AS image,
       CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(l_quantity * 20 AS BIGINT) END AS hint_cpu_m,
       CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(p_size * 16 AS BIGINT) END AS hint_mem_mib,
       o_orderstatus, l_linestatus, l_extendedprice, l_shipdate
FROM (SELECT l.*, p.p_brand, p.p_size, o.o_orderkey, o.o_custkey, o.o_orderstatus,
             CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey
               ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice,
                        l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS INT) AS idx
      FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
                      JOIN orders o ON l.l_orderkey = o.o_orderkey) n
"""
VIEWS["wf_deps"] = """
SELECT wf_id, task_name, CONCAT('t', CAST(CAST(FLOOR((idx - 1) / 2) AS INT) AS STRING)) AS dep FROM wf_tasks WHERE idx > 0
UNION ALL
SELECT wf_id, task_name, CONCAT('t', CAST(idx - 1 AS STRING)) AS dep FROM wf_tasks WHERE idx >= 3 AND idx % 3 = 0
UNION ALL
SELECT wf_id, task_name, 't999' AS dep FROM wf_tasks WHERE wf_id % 97 = 0 AND idx = 1
UNION ALL
SELECT wf_id, task_name, 't1' AS dep FROM wf_tasks WHERE wf_id % 101 = 0 AND idx = 0
"""
VIEWS["wf_status"] = """
SELECT wf_id, task_name, phase,
       CASE WHEN phase = 'Pending' THEN NULL ELSE COALESCE(hint_cpu_m, 100) END AS alloc_cpu_m,
       CASE WHEN phase = 'Pending' THEN NULL ELSE COALESCE(hint_mem_mib, 128) END AS alloc_mem_mib
FROM (SELECT *, CASE
        WHEN o_orderstatus = 'F' THEN CASE WHEN idx = 2 AND wf_id % 7 = 0 THEN 'Failed' ELSE 'Succeeded' END
        WHEN o_orderstatus = 'O' THEN 'Pending'
        WHEN idx = 0 THEN 'Succeeded'
        WHEN idx <= 2 THEN CASE WHEN l_linestatus = 'F' THEN 'Succeeded' ELSE 'Running' END
        ELSE 'Pending' END AS phase FROM wf_tasks) s
WHERE (wf_id + idx) % 41 <> 0
"""
VIEWS["wf_limits"] = """
SELECT DISTINCT wf_id,
       CASE WHEN wf_id % 10 = 0 THEN NULL ELSE CAST(500 + (wf_id % 4) * 500 AS BIGINT) END AS max_cpu_m,
       CASE WHEN wf_id % 9 = 0 THEN NULL ELSE CAST(512 + (wf_id % 3) * 512 AS BIGINT) END AS max_mem_mib,
       CASE WHEN wf_id % 2 = 0 THEN 'MinimizeTime' ELSE 'MinimizeCost' END AS goal
FROM wf_tasks
"""
VIEWS["wf_executions"] = """
SELECT CONCAT('wf-', CAST(l_orderkey AS STRING)) AS workflow_name,
       CONCAT('line-', CAST(l_linenumber AS STRING)) AS task_name, p_brand AS image,
       CAST(l_quantity * 20 AS BIGINT) AS actual_cpu_m,
       CAST(ROUND(l_discount * 10000) AS BIGINT) + 64 AS actual_mem_mib,
       l_extendedprice / 1000 AS duration_s,
       l_returnflag <> 'R' AS succeeded, l_shipdate AS completed_at
FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE p_brand NOT IN ('Brand#5', 'Brand#15', 'Brand#25')
"""
VIEWS["wf_pod_events"] = """
SELECT event_id, ts, user_id AS wf_id,
       CONCAT('t', CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 5 AS STRING)) AS task_name,
       CASE event_type WHEN 'signup' THEN 'Pending' WHEN 'view' THEN 'Running' WHEN 'click' THEN 'Running'
                       WHEN 'purchase' THEN 'Succeeded' WHEN 'error' THEN 'Failed' END AS pod_phase
FROM events
"""
VIEWS["wf_quantities"] = """
SELECT p_partkey AS id, CASE p_partkey % 7
         WHEN 0 THEN CONCAT(CAST(p_size AS STRING), 'm')
         WHEN 1 THEN CAST(p_size AS STRING)
         WHEN 2 THEN CONCAT(CAST(p_size AS STRING), '.5')
         WHEN 3 THEN CONCAT(CAST(p_size * 64 AS STRING), 'Mi')
         WHEN 4 THEN CONCAT(CAST(p_size AS STRING), 'Gi')
         WHEN 5 THEN CONCAT(CAST(p_size AS STRING), 'M')
         ELSE 'bad' END AS quantity
FROM part
"""
VIEWS["wf_pods"] = """
SELECT wf_id, namespace, workflow_name, workflow_name || '-' || task_name AS pod_name,
       CASE WHEN idx % 6 <> 5 THEN task_name END AS task_name,
       CASE WHEN l_linestatus = 'F' THEN image END AS image,
       CASE WHEN l_extendedprice < 25000 THEN 'Succeeded' WHEN l_extendedprice < 35000 THEN 'Failed'
            WHEN l_extendedprice < 50000 THEN 'Running' ELSE 'Pending' END AS pod_phase,
       CASE WHEN l_extendedprice < 20000 THEN l_shipdate + INTERVAL 1 HOUR END AS started_at,
       l_shipdate AS created_at
FROM wf_tasks WHERE o_orderstatus <> 'O'
"""
# Documents: one row per order, and one row per listed task.
VIEWS["docs"] = """
SELECT o_orderkey AS key, 'ns-' || (o_custkey % 5) AS namespace, 'wf-' || o_orderkey AS name,
       'ns-' || (o_custkey % 5) || '/wf-' || o_orderkey AS wf_id,
       CASE WHEN o_orderkey % 3 <> 0 THEN 'MinimizeCost' END AS goal,
       CASE WHEN o_orderkey % 40 <> 39 THEN CAST(o_orderkey % 7 + 1 AS INT) END AS n_tasks,
       o_orderstatus, o_orderpriority, o_orderdate
FROM orders
"""
VIEWS["doc_tasks"] = """
SELECT d.*, idx, 't' || idx AS task_name,
       CASE WHEN (key + idx) % 50 <> 0 THEN 'image-' || ((key + idx) % 12) END AS image,
       CASE WHEN idx % 2 = 0 THEN 'run ' || idx END AS command,
       CASE WHEN idx > 0 THEN 't' || (idx - 1) END AS dep,
       CASE WHEN idx % 3 <> 0 THEN ['500m', '1', '1.5', '250m', 'bad'][(key + idx) % 5 + 1] END AS cpu_text,
       CASE WHEN idx % 3 <> 0 THEN [500, 1000, 1500, 250, NULL][(key + idx) % 5 + 1] END AS hint_cpu_m,
       CASE WHEN idx % 3 <> 0 THEN 64 * (idx + 1) END AS hint_mem_mib
FROM (SELECT *, CAST(UNNEST(range(0, n_tasks)) AS INT) AS idx FROM docs) d
"""
# Operators that other oracles build on.
VIEWS["ready"] = """
SELECT t.* FROM wf_tasks t LEFT JOIN wf_status s ON s.wf_id = t.wf_id AND s.task_name = t.task_name
WHERE COALESCE(s.phase, 'Pending') = 'Pending'
  AND NOT EXISTS (SELECT 1 FROM wf_deps d
                  LEFT JOIN wf_status p ON p.wf_id = d.wf_id AND p.task_name = d.dep
                  WHERE d.wf_id = t.wf_id AND d.task_name = t.task_name
                    AND COALESCE(p.phase, 'none') <> 'Succeeded')
"""
VIEWS["usage"] = """
SELECT wf_id, CAST(SUM(alloc_cpu_m) AS BIGINT) AS used_cpu_m, CAST(SUM(alloc_mem_mib) AS BIGINT) AS used_mem_mib
FROM wf_status WHERE phase = 'Running' GROUP BY wf_id
HAVING SUM(alloc_cpu_m) <> 0 OR SUM(alloc_mem_mib) <> 0
"""
_PHASE = """
SELECT wf_id,
       CASE WHEN BOOL_OR(phase = 'Failed') THEN 'Failed'
            WHEN BOOL_AND(phase = 'Succeeded') THEN 'Completed' ELSE 'Running' END AS phase,
       MIN(CASE WHEN phase = 'Failed' THEN task_name END) AS failed_task,
       COUNT(*) FILTER (phase = 'Running') AS running_tasks
FROM {status} GROUP BY wf_id
"""
VIEWS["phases"] = _PHASE.format(status="wf_status")
VIEWS["history"] = f"""
SELECT image, AVG(actual_cpu_m) AS hist_cpu_m, AVG(actual_mem_mib) AS hist_mem_mib,
       AVG(duration_s) AS hist_duration_s, COUNT(*) AS n_samples
FROM wf_executions
WHERE succeeded AND completed_at > {AS_OF} - INTERVAL 30 DAY AND completed_at <= {AS_OF}
GROUP BY image
"""
VIEWS["enriched"] = """
SELECT t.*, COALESCE(h.hist_cpu_m, 0) AS hist_cpu_m, COALESCE(h.hist_mem_mib, 0) AS hist_mem_mib,
       COALESCE(h.hist_duration_s, 0) AS hist_duration_s, COALESCE(h.n_samples, 0) AS n_samples
FROM wf_tasks t LEFT JOIN history h ON h.image = t.image
"""
VIEWS["predicted"] = """
SELECT *, CASE WHEN n_samples > 0 THEN CAST(TRUNC(hist_cpu_m * CAST(1.2 AS DOUBLE)) AS BIGINT)
               WHEN hint_cpu_m > 0 THEN hint_cpu_m ELSE 100 END AS cpu_m,
       CASE WHEN n_samples > 0 THEN CAST(TRUNC(hist_mem_mib * CAST(1.2 AS DOUBLE)) AS BIGINT)
            WHEN hint_mem_mib > 0 THEN hint_mem_mib ELSE 128 END AS mem_mib,
       CASE WHEN n_samples > 0 THEN hist_duration_s * CAST(1.1 AS DOUBLE) ELSE 30.0 END AS duration_s,
       CASE WHEN n_samples > 0 THEN LEAST(0.7, 0.3 + n_samples * 0.04)
            WHEN hint_cpu_m > 0 OR hint_mem_mib > 0 THEN 0.3 ELSE 0.1 END AS confidence,
       CASE WHEN n_samples > 0 THEN 'history'
            WHEN hint_cpu_m > 0 OR hint_mem_mib > 0 THEN 'hint' ELSE 'default' END AS method
FROM enriched
"""
# Sizes of the two dialects for every task, with history predictions and without.
VIEWS["remote_sizes"] = """
SELECT wf_id, idx, task_name, cpu_m AS cpu_request_m, mem_mib AS mem_request_mib,
       CAST(TRUNC(cpu_m * CAST(1.5 AS DOUBLE)) AS BIGINT) AS cpu_limit_m,
       CAST(TRUNC(mem_mib * CAST(1.5 AS DOUBLE)) AS BIGINT) AS mem_limit_mib
FROM predicted
"""
VIEWS["local_sizes"] = """
SELECT wf_id, idx, task_name,
       CASE WHEN COALESCE(hint_cpu_m, hint_mem_mib) IS NULL THEN 100 ELSE hint_cpu_m END AS cpu_request_m,
       CASE WHEN COALESCE(hint_cpu_m, hint_mem_mib) IS NULL THEN 128 ELSE hint_mem_mib END AS mem_request_mib,
       CASE WHEN COALESCE(hint_cpu_m, hint_mem_mib) IS NULL THEN CAST(200 AS BIGINT) END AS cpu_limit_m,
       CASE WHEN COALESCE(hint_cpu_m, hint_mem_mib) IS NULL THEN CAST(256 AS BIGINT) END AS mem_limit_mib
FROM wf_tasks
"""
_QUEUE = """
SELECT s.*, CAST(ROW_NUMBER() OVER (PARTITION BY s.wf_id ORDER BY s.idx) AS INT) AS rn,
       COALESCE(l.max_cpu_m, 0) AS max_cpu, COALESCE(l.max_mem_mib, 0) AS max_mem,
       COALESCE(u.used_cpu_m, 0) AS used_cpu, COALESCE(u.used_mem_mib, 0) AS used_mem
FROM {sizes} s JOIN ready r ON r.wf_id = s.wf_id AND r.idx = s.idx {running}
LEFT JOIN wf_limits l ON l.wf_id = s.wf_id LEFT JOIN usage u ON u.wf_id = s.wf_id
"""
_WALK = """
SELECT wf_id, 0 AS rn, MIN(used_cpu) AS cpu, MIN(used_mem) AS mem, FALSE AS ok FROM {queue} GROUP BY wf_id
UNION ALL
SELECT w.wf_id, w.rn + 1,
       CASE WHEN (q.max_cpu = 0 OR w.cpu + q.cpu_request_m <= q.max_cpu)
             AND (q.max_mem = 0 OR w.mem + q.mem_request_mib <= q.max_mem)
            THEN w.cpu + q.cpu_request_m ELSE w.cpu END,
       CASE WHEN (q.max_cpu = 0 OR w.cpu + q.cpu_request_m <= q.max_cpu)
             AND (q.max_mem = 0 OR w.mem + q.mem_request_mib <= q.max_mem)
            THEN w.mem + q.mem_request_mib ELSE w.mem END,
       (q.max_cpu = 0 OR w.cpu + q.cpu_request_m <= q.max_cpu)
         AND (q.max_mem = 0 OR w.mem + q.mem_request_mib <= q.max_mem)
FROM {walk} w JOIN {queue} q ON q.wf_id = w.wf_id AND q.rn = w.rn + 1
"""
_ADMITTED = """
SELECT q.wf_id, q.idx, q.task_name,
       CAST(ROW_NUMBER() OVER (PARTITION BY q.wf_id ORDER BY q.idx) - 1 AS INT) AS admit_seq,
       q.cpu_request_m, q.mem_request_mib, q.cpu_limit_m, q.mem_limit_mib
FROM {queue} q JOIN {walk} w ON w.wf_id = q.wf_id AND w.rn = q.rn WHERE w.ok
"""
_RUNNING = "JOIN phases f ON f.wf_id = s.wf_id AND f.phase = 'Running'"
for _name, _sizes, _filter in [
    ("all_local", "local_sizes", ""),
    ("run_local", "local_sizes", _RUNNING),
    ("run_remote", "remote_sizes", _RUNNING),
]:
    VIEWS[f"{_name}_queue"] = _QUEUE.format(sizes=_sizes, running=_filter)
    VIEWS[f"{_name}_walk"] = _WALK.format(queue=f"{_name}_queue", walk=f"{_name}_walk")
    VIEWS[f"{_name}_plan"] = _ADMITTED.format(queue=f"{_name}_queue", walk=f"{_name}_walk")
VIEWS["pod_ends"] = """
SELECT wf_id, task_name, ARG_MIN(pod_phase, pod_name) AS pod_phase, ARG_MIN(workflow_name, pod_name) AS workflow_name,
       FIRST(image ORDER BY pod_name) AS image, MIN_BY(COALESCE(started_at, created_at), pod_name) AS since
FROM wf_pods WHERE task_name IS NOT NULL AND pod_phase IN ('Succeeded', 'Failed') GROUP BY wf_id, task_name
"""
VIEWS["synced"] = """
SELECT s.wf_id, s.task_name,
       CASE WHEN s.phase = 'Running' AND p.pod_phase IS NOT NULL THEN p.pod_phase ELSE s.phase END AS phase,
       s.alloc_cpu_m, s.alloc_mem_mib
FROM wf_status s LEFT JOIN pod_ends p ON p.wf_id = s.wf_id AND p.task_name = s.task_name
"""
VIEWS["synced_phases"] = _PHASE.format(status="synced")
_CONDITIONS = """
SELECT wf_id, 'Available' AS type, 'False' AS status, 'TaskFailed' AS reason,
       'Task "' || failed_task || '" failed' AS message FROM {phases} WHERE phase = 'Failed'
UNION ALL SELECT wf_id, 'Progressing', 'False', 'TaskFailed',
       'Workflow stopped because task "' || failed_task || '" failed' FROM {phases} WHERE phase = 'Failed'
UNION ALL SELECT wf_id, 'Available', 'True', 'AllTasksSucceeded', 'All workflow tasks completed successfully'
       FROM {phases} WHERE phase = 'Completed'
UNION ALL SELECT wf_id, 'Progressing', 'False', 'Completed', 'Workflow execution is complete'
       FROM {phases} WHERE phase = 'Completed'
UNION ALL SELECT wf_id, 'Progressing', 'True', 'Reconciling', running_tasks || ' tasks running'
       FROM {phases} WHERE phase = 'Running'
"""
VIEWS["conditions"] = _CONDITIONS.format(phases="phases")
VIEWS["synced_conditions"] = _CONDITIONS.format(phases="synced_phases")
VIEWS["applied"] = """
SELECT COALESCE(s.wf_id, p.wf_id) AS wf_id, COALESCE(s.task_name, p.task_name) AS task_name,
       CASE WHEN p.wf_id IS NOT NULL THEN 'Running' ELSE s.phase END AS phase,
       CASE WHEN p.wf_id IS NOT NULL THEN 'wf-' || p.wf_id || '-' || p.task_name END AS pod_name,
       COALESCE(p.cpu_request_m, s.alloc_cpu_m) AS alloc_cpu_m,
       COALESCE(p.mem_request_mib, s.alloc_mem_mib) AS alloc_mem_mib
FROM wf_status s FULL JOIN run_remote_plan p ON p.wf_id = s.wf_id AND p.task_name = s.task_name
"""
VIEWS["stacked"] = """
SELECT wf_id, idx, CAST(idx // 3 AS BIGINT) AS start, size,
       CAST(COALESCE(SUM(size) OVER (PARTITION BY wf_id, idx // 3 ORDER BY idx
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bottom
FROM (SELECT wf_id, idx, COALESCE(hint_mem_mib, 128) AS size FROM wf_tasks)
"""
VIEWS["intervals"] = """
SELECT workflow_name AS wf_id,
       epoch_us(completed_at) - CAST(TRUNC(duration_s * 3600000000) AS BIGINT) * 24 AS t0,
       epoch_us(completed_at) AS t1, actual_mem_mib AS size
FROM wf_executions
"""
# The definition taken literally: at each instant, every interval that covers it.
VIEWS["profile"] = """
SELECT p.wf_id, p.t, LEAD(p.t) OVER (PARTITION BY p.wf_id ORDER BY p.t) AS until,
       CAST(COALESCE((SELECT SUM(size) FROM intervals i
                      WHERE i.wf_id = p.wf_id AND i.t0 <= p.t AND i.t1 > p.t), 0) AS BIGINT) AS in_use
FROM (SELECT wf_id, t0 AS t FROM intervals WHERE t1 > t0 UNION SELECT wf_id, t1 FROM intervals WHERE t1 > t0) p
"""
VIEWS["runs_by_instant"] = """
SELECT image, completed_at, CAST(SUM(actual_cpu_m) AS DOUBLE) AS c, CAST(SUM(actual_mem_mib) AS DOUBLE) AS m,
       SUM(duration_s) AS d, COUNT(*) AS n
FROM wf_executions WHERE succeeded GROUP BY image, completed_at
"""
VIEWS["rolling"] = """
SELECT t.image, t.completed_at, COALESCE(SUM(r.c) / SUM(r.n), 0) AS hist_cpu_m,
       COALESCE(SUM(r.m) / SUM(r.n), 0) AS hist_mem_mib, COALESCE(SUM(r.d) / SUM(r.n), 0) AS hist_duration_s,
       CAST(COALESCE(SUM(r.n), 0) AS BIGINT) AS n_samples
FROM (SELECT DISTINCT image, completed_at FROM wf_executions) t
LEFT JOIN runs_by_instant r ON r.image = t.image AND r.completed_at < t.completed_at
                           AND r.completed_at > t.completed_at - INTERVAL 30 DAY
GROUP BY t.image, t.completed_at
"""
# Edges between tasks of the document, as positions.
VIEWS["arcs"] = """
SELECT DISTINCT d.wf_id, s.idx AS src, t.idx AS dst
FROM wf_deps d JOIN wf_tasks s ON s.wf_id = d.wf_id AND s.task_name = d.dep
               JOIN wf_tasks t ON t.wf_id = d.wf_id AND t.task_name = d.task_name
"""
VIEWS["reach"] = """
SELECT wf_id, src, dst FROM arcs
UNION SELECT r.wf_id, r.src, a.dst FROM reach r JOIN arcs a ON a.wf_id = r.wf_id AND a.src = r.dst
"""
VIEWS["cyclic"] = """
SELECT wf_id, dst AS idx FROM reach r
WHERE EXISTS (SELECT 1 FROM reach c WHERE c.wf_id = r.wf_id AND c.src = r.src AND c.dst = r.src)
GROUP BY wf_id, dst
"""
VIEWS["stuck"] = """
SELECT wf_id, idx FROM cyclic
UNION SELECT t.wf_id, t.idx FROM wf_tasks t JOIN wf_deps d ON d.wf_id = t.wf_id AND d.task_name = t.task_name
      WHERE d.dep NOT IN (SELECT task_name FROM wf_tasks k WHERE k.wf_id = d.wf_id)
UNION SELECT r.wf_id, r.dst FROM reach r JOIN wf_tasks t ON t.wf_id = r.wf_id AND t.idx = r.src
      JOIN wf_deps d ON d.wf_id = t.wf_id AND d.task_name = t.task_name
      WHERE d.dep NOT IN (SELECT task_name FROM wf_tasks k WHERE k.wf_id = d.wf_id)
"""
VIEWS["free_arcs"] = """
SELECT a.* FROM arcs a ANTI JOIN cyclic c ON c.wf_id = a.wf_id AND c.idx = a.dst
"""
_PATHS = """
SELECT wf_id, idx, CAST(0 AS DOUBLE) AS t0, l_extendedprice / 1000 AS t1 FROM wf_tasks
UNION ALL
SELECT p.wf_id, a.dst, p.t1, p.t1 + t.l_extendedprice / 1000
FROM {paths} p JOIN {arcs} a ON a.wf_id = p.wf_id AND a.src = p.idx
             JOIN wf_tasks t ON t.wf_id = p.wf_id AND t.idx = a.dst
"""
VIEWS["paths"] = _PATHS.format(paths="paths", arcs="free_arcs")
VIEWS["spec_arcs"] = "SELECT * FROM arcs WHERE src < dst"
VIEWS["spec_paths"] = _PATHS.format(paths="spec_paths", arcs="spec_arcs")
# The phase machine walked event by event.
_MACHINE_QUEUE = """
SELECT e.wf_id, e.task_name, e.ts, e.pod_phase, {start} AS start,
       CAST(ROW_NUMBER() OVER (PARTITION BY e.wf_id, e.task_name ORDER BY e.ts, e.event_id) AS INT) AS rn
FROM wf_pod_events e {join}
"""
_MACHINE = """
SELECT wf_id, task_name, 0 AS rn, ANY_VALUE(start) AS phase, CAST(NULL AS TIMESTAMP) AS started, CAST(NULL AS TIMESTAMP) AS ended
FROM {queue} GROUP BY wf_id, task_name
UNION ALL
SELECT m.wf_id, m.task_name, m.rn + 1,
       CASE WHEN m.phase = 'Pending' AND q.pod_phase = 'Running' THEN 'Running'
            WHEN m.phase = 'Running' AND q.pod_phase IN ('Succeeded', 'Failed') THEN q.pod_phase
            ELSE m.phase END,
       CASE WHEN m.phase = 'Pending' AND q.pod_phase = 'Running' THEN q.ts ELSE m.started END,
       CASE WHEN m.phase = 'Running' AND q.pod_phase IN ('Succeeded', 'Failed') THEN q.ts ELSE m.ended END
FROM {machine} m JOIN {queue} q ON q.wf_id = m.wf_id AND q.task_name = m.task_name AND q.rn = m.rn + 1
"""
_FINAL = "SELECT * FROM {machine} QUALIFY ROW_NUMBER() OVER (PARTITION BY wf_id, task_name ORDER BY rn DESC) = 1"
for _name, _start, _join in [
    ("fresh", "'Pending'", ""),
    ("stored", "COALESCE(s.phase, 'Pending')",
     "LEFT JOIN wf_status s ON s.wf_id = e.wf_id AND s.task_name = e.task_name"),
]:
    VIEWS[f"{_name}_events"] = _MACHINE_QUEUE.format(start=_start, join=_join)
    VIEWS[f"{_name}_machine"] = _MACHINE.format(queue=f"{_name}_events", machine=f"{_name}_machine")
    VIEWS[f"{_name}_final"] = _FINAL.format(machine=f"{_name}_machine")
# Synthetic samples: sixteen uniform draws from two digests, two per normal draw.
VIEWS["draws"] = """
SELECT o_orderkey AS sample_id, LIST_TRANSFORM(RANGE(0, 16), lambda i:
         (CAST(CAST('0x' || SUBSTR(CASE WHEN i < 8 THEN a ELSE b END, CAST(8 * (i % 8) + 1 AS BIGINT), 8) AS BIGINT) AS DOUBLE) + 0.5)
         / CAST(4294967296 AS DOUBLE)) AS u
FROM (SELECT o_orderkey, SHA256('42|0|' || o_orderkey) AS a, SHA256('42|1|' || o_orderkey) AS b FROM orders)
"""
VIEWS["profiles"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{image}', {cpu}.0, {mem}.0, {seconds}.0)"
    for i, (image, (cpu, mem, seconds)) in enumerate(PROFILES.items())
) + ") v(pick, image, cpu, mem, dur)"


def _noisy(base: str, noise: float, draw: int, floor: int) -> str:
    normal = f"SQRT(-2 * LN(u[{draw}])) * COS(2 * PI() * u[{draw + 1}])"
    return f"ROUND(GREATEST(CAST({floor} AS DOUBLE), CAST({base} AS DOUBLE) * (1 + {noise} * {normal})) + 1e-9, 6)"


VIEWS["after_events"] = """
SELECT wf_id, task_name, phase FROM stored_final
UNION ALL SELECT wf_id, task_name, phase FROM wf_status s
WHERE NOT EXISTS (SELECT 1 FROM wf_pod_events e WHERE e.wf_id = s.wf_id AND e.task_name = s.task_name)
"""


def sql(body: str) -> str:
    """``body`` with the views it needs in front."""
    needed: set[str] = set()
    queue = [body]
    while queue:
        text = queue.pop()
        for name, definition in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                queue.append(definition)
    if not needed:
        return body
    views = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in VIEWS if name in needed)
    return f"WITH RECURSIVE {views}\n{body.strip()}"


_EXECUTION = """workflow_name, task_name, image, actual_cpu_m, actual_mem_mib,
       ROUND(duration_s + 1e-9, 6) AS duration_s, succeeded, epoch_us(completed_at) AS completed_us"""

ORACLES: dict[str, str] = {
    "read_manifests": """
SELECT CASE WHEN o_orderpriority <> '5-LOW' THEN namespace ELSE 'default' END AS namespace, name,
       COALESCE(goal, 'MinimizeTime') AS goal, CAST(1 + key % 4 AS STRING) AS max_cpu, n_tasks,
       (SELECT COALESCE(STRING_AGG(t.image, ',' ORDER BY t.idx), '') FROM doc_tasks t WHERE t.key = d.key AND d.n_tasks IS NOT NULL)
         || CASE WHEN n_tasks IS NULL THEN NULL ELSE '' END AS images
FROM docs d""",
    "upsert_manifests": """
SELECT namespace, name,
       CASE WHEN o_orderstatus = 'F' THEN goal WHEN o_orderpriority = '1-URGENT' THEN 'second' ELSE 'first' END AS goal,
       n_tasks, CASE WHEN o_orderstatus <> 'O' THEN 'Running' END AS phase
FROM docs""",
    "document_versions": """
SELECT namespace, name,
       CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 'late' ELSE goal END AS goal,
       CASE WHEN o_orderstatus <> 'O' THEN 'Running' END AS phase,
       CAST(CASE WHEN o_orderstatus <> 'O' THEN 2 WHEN o_orderpriority = '1-URGENT' THEN 3 ELSE 1 END AS BIGINT) AS resource_version,
       o_orderstatus <> 'O' AND o_orderpriority = '1-URGENT' AS refused
FROM docs""",
    "delete_cascade": """
SELECT 'workflow' AS kind, namespace, name FROM docs WHERE o_orderpriority <> '1-URGENT'
UNION ALL
SELECT 'pod', p.namespace, p.pod_name FROM wf_pods p
WHERE NOT EXISTS (SELECT 1 FROM docs d WHERE d.namespace = p.namespace AND d.name = p.workflow_name
                  AND d.o_orderpriority = '1-URGENT')""",
    "read_history": f"""
SELECT {_EXECUTION} FROM wf_executions
WHERE succeeded AND completed_at > {AS_OF} - INTERVAL 30 DAY AND completed_at <= {AS_OF}""",
    "record_executions": f"""
SELECT 'wf-' || o_orderkey AS workflow_name, 't' || i AS task_name, 'image-' || ((o_orderkey + i) % 12) AS image,
       CAST(100 + i * 10 AS BIGINT) AS actual_cpu_m, CAST(64 + i AS BIGINT) AS actual_mem_mib,
       CAST(1.5 * i AS DOUBLE) AS duration_s, i % 3 <> 1 AS succeeded,
       epoch_us(CASE WHEN i % 2 = 0 THEN o_orderdate ELSE {AS_OF} END) AS completed_us
FROM (SELECT *, UNNEST(range(0, o_orderkey % 4 + 1)) AS i FROM orders
      WHERE o_orderkey % 13 <> 0 OR o_orderkey % 4 = 0)""",
    "record_rejects": """
SELECT 'wf-' || o_orderkey AS workflow_name, CAST(o_orderkey % 4 + 1 AS INT) AS n_tasks,
       'malformed completed_at "yesterday"' AS reason
FROM orders WHERE o_orderkey % 13 = 0 AND o_orderkey % 4 > 0""",
    "export_workflows_json": """
SELECT namespace, name,
       '{"metadata":{"namespace":"' || namespace || '","name":"' || name || '"},"spec":{'
       || COALESCE('"optimizationGoal":"' || goal || '",', '')
       || '"maxResources":{"cpu":"' || (1 + key % 4) || '","memory":"2Gi"}'
       || COALESCE(',"tasks":[' || (SELECT STRING_AGG(
            '{"name":"' || task_name || '"' || COALESCE(',"image":"' || image || '"', '')
            || COALESCE(',"command":["run","' || CASE WHEN command IS NOT NULL THEN idx END || '"]', '')
            || COALESCE(',"dependencies":["' || dep || '"]', '')
            || ',"baseResources":{' || COALESCE('"requests":{"cpu":"' || cpu_text || '","memory":"' || hint_mem_mib || 'Mi"}', '')
            || '}}', ',' ORDER BY idx) FROM doc_tasks t WHERE t.key = d.key) || ']', '')
       || '}}' AS doc
FROM docs d""",
    "generate_executions": f"""
SELECT sample_id, image, {_noisy('cpu', 0.2, 2, 10)} AS hist_cpu_m, {_noisy('mem', 0.2, 4, 8)} AS hist_mem_mib,
       {_noisy('dur', 0.2, 6, 1)} AS hist_duration_s, {_noisy('cpu', 0.15, 8, 10)} AS actual_cpu_m,
       {_noisy('mem', 0.15, 10, 8)} AS actual_mem_mib, {_noisy('dur', 0.15, 12, 1)} AS duration_s
FROM draws JOIN profiles ON pick = CAST(FLOOR(u[1] * 12) AS INT)""",
    "discard_metrics": """
SELECT e.image, ROUND(COALESCE(hist_cpu_m, 0) + 1e-9, 6) AS hist_cpu_m,
       ROUND(COALESCE(hist_mem_mib, 0) + 1e-9, 6) AS hist_mem_mib,
       ROUND(COALESCE(hist_duration_s, 0) + 1e-9, 6) AS hist_duration_s, COALESCE(n_samples, 0) AS n_samples
FROM (SELECT DISTINCT image FROM wf_executions) e LEFT JOIN history h ON h.image = e.image""",
    "flatten_tasks": """
SELECT wf_id, name AS workflow_name, idx, task_name, image, dep AS dependencies,
       CAST(hint_cpu_m AS BIGINT) AS hint_cpu_m, CAST(hint_mem_mib AS BIGINT) AS hint_mem_mib
FROM doc_tasks""",
    "parse_quantity": """
SELECT id, quantity,
       CAST(CASE WHEN quantity LIKE '%m' THEN CAST(REPLACE(quantity, 'm', '') AS BIGINT)
            WHEN quantity LIKE '%Mi' THEN CAST(REPLACE(quantity, 'Mi', '') AS BIGINT) * 1048576000
            WHEN quantity LIKE '%Gi' THEN CAST(REPLACE(quantity, 'Gi', '') AS BIGINT) * 1073741824000
            WHEN quantity LIKE '%M' THEN CAST(REPLACE(quantity, 'M', '') AS BIGINT) * 1000000000
            WHEN quantity <> 'bad' THEN CEIL(CAST(quantity AS DECIMAL(18,3)) * 1000) END AS BIGINT) AS cpu_m,
       CAST(CASE WHEN quantity LIKE '%m' THEN 0
            WHEN quantity LIKE '%Mi' THEN CAST(REPLACE(quantity, 'Mi', '') AS BIGINT)
            WHEN quantity LIKE '%Gi' THEN CAST(REPLACE(quantity, 'Gi', '') AS BIGINT) * 1024
            WHEN quantity LIKE '%M' THEN CAST(REPLACE(quantity, 'M', '') AS BIGINT) * 1000000 // 1048576
            WHEN quantity <> 'bad' THEN 0 END AS BIGINT) AS mem_mib
FROM wf_quantities""",
    "format_quantity": """
SELECT wf_id, idx, hint_cpu_m || 'm' AS cpu, hint_mem_mib || 'Mi' AS mem FROM wf_tasks""",
    "image_hash": """
SELECT p_partkey, CAST(CAST('0x' || SUBSTR(SHA256(p_brand || ':' || p_name), 1, 8) AS BIGINT) AS DOUBLE)
       / CAST(4294967296 AS DOUBLE) AS image_hash
FROM part""",
    "pod_spec": """
SELECT wf_id, namespace, LOWER(name || '-' || task_name) AS pod_name, task_name, name AS workflow_label,
       task_name AS task_label, 'Never' AS restart_policy, image,
       COALESCE(command, 'echo Running task ' || task_name) AS command,
       CAST(CASE WHEN hint_mem_mib IS NULL THEN 100 ELSE hint_cpu_m END AS BIGINT) AS cpu_request_m,
       CAST(CASE WHEN hint_mem_mib IS NULL THEN 128 ELSE hint_mem_mib END AS BIGINT) AS mem_request_mib,
       CAST(CASE WHEN hint_mem_mib IS NULL THEN 200 END AS BIGINT) AS cpu_limit_m,
       CAST(CASE WHEN hint_mem_mib IS NULL THEN 256 END AS BIGINT) AS mem_limit_mib
FROM doc_tasks""",
    "pod_spec_rejects": """
SELECT t.namespace || '/' || t.workflow_name AS wf_id, t.task_name, 'task "' || t.task_name || '" not found in spec' AS error
FROM wf_tasks t WHERE NOT EXISTS (SELECT 1 FROM doc_tasks d
     WHERE d.wf_id = t.namespace || '/' || t.workflow_name AND d.task_name = t.task_name)""",
    "parse_dependency_csv": """
SELECT p_partkey, CAST(LEN(l) AS INT) AS n, ARRAY_TO_STRING(l, '|') AS names
FROM (SELECT p_partkey, LIST_FILTER(LIST_TRANSFORM(STRING_SPLIT(COALESCE(CASE WHEN p_size > 1 THEN
        TRANSLATE(p_name, ' ', ',') || ' , ' || p_brand || ', ,' END, ''), ','), lambda x: TRIM(x)), lambda x: x <> '') AS l
      FROM part)""",
    "validate_manifests": """
SELECT d.namespace, d.name, CASE WHEN n_tasks IS NULL THEN 'tasks missing' ELSE
       CONCAT_WS('; ', CASE WHEN t.no_image THEN 'task image missing' END,
                       CASE WHEN t.bad THEN 'bad request quantity' END) END AS reasons
FROM docs d LEFT JOIN (SELECT key, BOOL_OR(image IS NULL) AS no_image, COALESCE(BOOL_OR(cpu_text = 'bad'), FALSE) AS bad
                       FROM doc_tasks GROUP BY key) t ON t.key = d.key""",
    "workflow_lookup": "SELECT namespace, name FROM docs WHERE namespace = 'ns-1'",
    "init_status": """
SELECT d.wf_id, t.task_name, CASE WHEN t.task_name IS NOT NULL THEN 'Pending' END AS phase, 'Pending' AS wf_phase,
       'Workflow initialized with ' || COALESCE(d.n_tasks, 0) || ' tasks' AS message
FROM docs d LEFT JOIN doc_tasks t ON t.key = d.key""",
    "dependency_edges": "SELECT wf_id, task_name, dep FROM doc_tasks WHERE dep IS NOT NULL",
    "ready_tasks": "SELECT wf_id, idx, task_name FROM ready",
    "sync_pod_status": "SELECT * FROM synced",
    "sync_pod_executions": f"""
SELECT p.workflow_name, s.task_name, COALESCE(p.image, 'unknown') AS image, s.alloc_cpu_m AS actual_cpu_m,
       s.alloc_mem_mib AS actual_mem_mib,
       ROUND((epoch_us({AS_OF}) - epoch_us(p.since)) / CAST(1000000 AS DOUBLE) + 1e-9, 6) AS duration_s,
       TRUE AS succeeded, epoch_us({AS_OF}) AS completed_us
FROM wf_status s JOIN pod_ends p ON p.wf_id = s.wf_id AND p.task_name = s.task_name
WHERE s.phase = 'Running' AND p.pod_phase = 'Succeeded'""",
    "pods_to_create": """
SELECT r.namespace, r.workflow_name || '-' || r.task_name AS pod_name, r.wf_id, r.task_name,
       s.cpu_request_m, s.mem_request_mib
FROM ready r JOIN local_sizes s ON s.wf_id = r.wf_id AND s.idx = r.idx
WHERE NOT EXISTS (SELECT 1 FROM wf_pods p WHERE p.namespace = r.namespace
                  AND p.pod_name = r.workflow_name || '-' || r.task_name)""",
    "status_report": """
SELECT t.wf_id, t.idx, t.task_name, COALESCE(s.phase, 'Unknown') AS phase, '-' AS pod,
       COALESCE(s.alloc_cpu_m || 'm', '-') AS cpu, COALESCE(s.alloc_mem_mib || 'Mi', '-') AS mem
FROM wf_tasks t LEFT JOIN wf_status s ON s.wf_id = t.wf_id AND s.task_name = t.task_name""",
    "enrich_with_history": """
SELECT wf_id, idx, image, ROUND(hist_cpu_m + 1e-9, 6) AS hist_cpu_m, ROUND(hist_mem_mib + 1e-9, 6) AS hist_mem_mib,
       ROUND(hist_duration_s + 1e-9, 6) AS hist_duration_s, n_samples
FROM enriched""",
    "resolve_resources_local": """
SELECT t.wf_id, t.idx, t.task_name,
       CASE WHEN t.n_samples > 0 THEN r.cpu_request_m ELSE l.cpu_request_m END AS cpu_request_m,
       CASE WHEN t.n_samples > 0 THEN r.mem_request_mib ELSE l.mem_request_mib END AS mem_request_mib,
       CASE WHEN t.n_samples > 0 THEN r.cpu_limit_m ELSE l.cpu_limit_m END AS cpu_limit_m,
       CASE WHEN t.n_samples > 0 THEN r.mem_limit_mib ELSE l.mem_limit_mib END AS mem_limit_mib
FROM enriched t JOIN remote_sizes r ON r.wf_id = t.wf_id AND r.idx = t.idx
                JOIN local_sizes l ON l.wf_id = t.wf_id AND l.idx = t.idx""",
    "resolve_resources": """
SELECT t.wf_id, t.idx, t.task_name,
       CASE WHEN t.n_samples > 0 THEN r.cpu_request_m ELSE l.cpu_request_m END AS cpu_request_m,
       CASE WHEN t.n_samples > 0 THEN r.mem_request_mib ELSE l.mem_request_mib END AS mem_request_mib,
       CASE WHEN t.n_samples > 0 THEN r.cpu_limit_m ELSE 2 * l.cpu_request_m END AS cpu_limit_m,
       CASE WHEN t.n_samples > 0 THEN r.mem_limit_mib ELSE 2 * l.mem_request_mib END AS mem_limit_mib
FROM enriched t JOIN remote_sizes r ON r.wf_id = t.wf_id AND r.idx = t.idx
                JOIN local_sizes l ON l.wf_id = t.wf_id AND l.idx = t.idx""",
    "predict_baseline": """
SELECT wf_id, task_name, hint_cpu_m AS cpu_m, hint_mem_mib AS mem_mib, CAST(0 AS DOUBLE) AS duration_s
FROM wf_tasks WHERE hint_cpu_m IS NOT NULL OR hint_mem_mib IS NOT NULL""",
    "predict_resources": """
SELECT wf_id, task_name, cpu_m, mem_mib, ROUND(CAST(duration_s AS DOUBLE) + 1e-9, 6) AS duration_s,
       ROUND(CAST(confidence AS DOUBLE) + 1e-9, 6) AS confidence, method
FROM predicted""",
    "image_history": """
SELECT image, ROUND(hist_cpu_m + 1e-9, 6) AS hist_cpu_m, ROUND(hist_mem_mib + 1e-9, 6) AS hist_mem_mib,
       ROUND(hist_duration_s + 1e-9, 6) AS hist_duration_s, n_samples
FROM history""",
    "resource_usage": "SELECT * FROM usage",
    "list_workflows": """
SELECT h.wf_id, namespace, name, p.phase, n || ' (' || COALESCE(running_tasks, 0) || ' running)' AS tasks,
       COALESCE(running_tasks, 0) AS running_tasks, age AS age_s,
       CASE WHEN age >= 3600 THEN (age // 3600) || 'h' || (age % 3600 // 60) || 'm' || (age % 60) || 's'
            WHEN age >= 60 THEN (age // 60) || 'm' || (age % 60) || 's' ELSE age || 's' END AS age
FROM (SELECT o_orderkey AS wf_id, 'ns-' || (o_custkey % 5) AS namespace, 'wf-' || o_orderkey AS name,
             (SELECT COUNT(*) FROM wf_tasks t WHERE t.wf_id = o_orderkey) AS n,
             CAST(ROUND((epoch_us(TIMESTAMP '2003-01-01 12:34:56.7') - epoch_us(o_orderdate)) / 1000000) AS BIGINT) AS age
      FROM orders) h LEFT JOIN phases p ON p.wf_id = h.wf_id""",
    "workflow_phase": """
SELECT o_orderkey AS wf_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'Completed' ELSE phase END AS phase,
       CASE WHEN o_orderpriority <> '1-URGENT' THEN failed_task END AS failed_task
FROM orders o LEFT JOIN phases p ON o.o_orderkey = p.wf_id
WHERE p.wf_id IS NOT NULL OR o_orderpriority = '1-URGENT'""",
    "workflow_conditions": "SELECT * FROM conditions",
    "merge_conditions": """
SELECT * FROM synced_conditions
UNION ALL
SELECT * FROM conditions c WHERE NOT EXISTS
  (SELECT 1 FROM synced_conditions s WHERE s.wf_id = c.wf_id AND s.type = c.type)""",
    "stack_by_start": """
SELECT s.wf_id, idx, start, bottom, size, COALESCE(bottom + size > max_mem_mib, FALSE) AS crashed
FROM stacked s JOIN wf_limits l ON l.wf_id = s.wf_id""",
    "stack_crashes": "SELECT wf_id, BOOL_OR(bottom + size > 1500) AS is_crasher FROM stacked GROUP BY wf_id",
    "usage_profile": """
SELECT wf_id, t AS at, until, in_use, in_use > 1500 AS over_limit FROM profile""",
    "usage_peaks": """
SELECT wf_id, MAX(in_use) AS peak, CAST(COALESCE(SUM(CASE WHEN in_use > 1500 THEN until - t END), 0) AS BIGINT) AS time_over_limit
FROM profile GROUP BY wf_id""",
    "rolling_image_history": """
SELECT image, epoch_us(completed_at) AS completed_us, ROUND(hist_cpu_m + 1e-9, 6) AS hist_cpu_m,
       ROUND(hist_mem_mib + 1e-9, 6) AS hist_mem_mib, ROUND(hist_duration_s + 1e-9, 6) AS hist_duration_s, n_samples
FROM rolling""",
    "admit_tasks": "SELECT * FROM all_local_plan",
    "plan_cycle": "SELECT * FROM run_remote_plan",
    "plan_cycle_local": "SELECT * FROM run_local_plan",
    "apply_plan": "SELECT * FROM applied",
    "apply_plan_usage": """
SELECT wf_id, CAST(SUM(alloc_cpu_m) AS BIGINT) AS used_cpu_m, CAST(SUM(alloc_mem_mib) AS BIGINT) AS used_mem_mib
FROM applied WHERE phase = 'Running' GROUP BY wf_id
HAVING SUM(alloc_cpu_m) <> 0 OR SUM(alloc_mem_mib) <> 0""",
    "earliest_start": """
SELECT t.wf_id, t.idx, t.task_name,
       CASE WHEN c.idx IS NULL THEN ROUND(MAX(p.t0) + 1e-9, 6) END AS start,
       CASE WHEN c.idx IS NULL THEN ROUND(MAX(p.t0) + MAX(t.l_extendedprice) / 1000 + 1e-9, 6) END AS end
FROM wf_tasks t LEFT JOIN cyclic c ON c.wf_id = t.wf_id AND c.idx = t.idx
JOIN paths p ON p.wf_id = t.wf_id AND p.idx = t.idx
GROUP BY t.wf_id, t.idx, t.task_name, c.idx""",
    "earliest_start_spec_order": """
SELECT t.wf_id, t.idx, t.task_name, ROUND(MAX(p.t0) + 1e-9, 6) AS start,
       ROUND(MAX(p.t0) + MAX(t.l_extendedprice) / 1000 + 1e-9, 6) AS end
FROM wf_tasks t JOIN spec_paths p ON p.wf_id = t.wf_id AND p.idx = t.idx
GROUP BY t.wf_id, t.idx, t.task_name""",
    "dag_lint": """
SELECT d.wf_id, d.task_name, 'dangling' AS issue, d.dep AS detail FROM wf_deps d
WHERE NOT EXISTS (SELECT 1 FROM wf_tasks t WHERE t.wf_id = d.wf_id AND t.task_name = d.dep)
UNION ALL
SELECT wf_id, task_name, 'duplicate', CAST(COUNT(*) AS STRING) FROM wf_tasks GROUP BY wf_id, task_name HAVING COUNT(*) > 1
UNION ALL
SELECT s.wf_id, 't' || s.idx, CASE WHEN c.src IS NULL THEN 'blocked' ELSE 'cycle' END, CAST(NULL AS STRING)
FROM stuck s LEFT JOIN (SELECT DISTINCT wf_id, src FROM reach WHERE src = dst) c ON c.wf_id = s.wf_id AND c.src = s.idx""",
    "training_set": """
SELECT e.workflow_name, e.task_name, e.image, epoch_us(e.completed_at) AS completed_us,
       CAST(CAST('0x' || SUBSTR(SHA256(e.image), 1, 8) AS BIGINT) AS DOUBLE) / CAST(4294967296 AS DOUBLE) AS image_hash,
       ROUND(hist_cpu_m + 1e-9, 6) AS hist_cpu_m, ROUND(hist_mem_mib + 1e-9, 6) AS hist_mem_mib,
       ROUND(hist_duration_s + 1e-9, 6) AS hist_duration_s, actual_cpu_m, actual_mem_mib, ROUND(duration_s + 1e-9, 6) AS duration_s
FROM wf_executions e JOIN rolling r ON r.image = e.image AND r.completed_at = e.completed_at
WHERE e.succeeded AND r.n_samples > 0""",
    "split_train_test": """
SELECT workflow_name, task_name, image, epoch_us(completed_at) AS completed_us,
       CASE WHEN CAST('0x' || SUBSTR(SHA256('42|' || workflow_name || '|' || task_name || '|' || image || '|'
            || epoch_us(completed_at)), 1, 8) AS BIGINT) % 100 < 80 THEN 'train' ELSE 'test' END AS part
FROM wf_executions""",
    "recent_executions": f"SELECT {_EXECUTION} FROM wf_executions",
    "recent_executions_top": f"""
SELECT {_EXECUTION} FROM
(SELECT * FROM wf_executions ORDER BY completed_at DESC, workflow_name, task_name, image, duration_s LIMIT 100)""",
    "executions_of": f"""
SELECT {_EXECUTION} FROM wf_executions WHERE workflow_name = 'wf-102' AND task_name = 'line-6'""",
    "task_phases": """
SELECT wf_id, task_name, phase, epoch_us(started) AS started_us, epoch_us(ended) AS ended_us, CAST(rn AS BIGINT) AS n_events
FROM fresh_final""",
    "fold_phases": """
SELECT wf_id, task_name, f.phase, COALESCE(s.phase, 'Pending') AS before, CAST(rn AS BIGINT) AS n_events
FROM stored_final f LEFT JOIN wf_status s USING (wf_id, task_name)
UNION ALL
SELECT wf_id, task_name, phase, phase, 0 FROM wf_status s
WHERE NOT EXISTS (SELECT 1 FROM wf_pod_events e WHERE e.wf_id = s.wf_id AND e.task_name = s.task_name)""",
    "task_phase_stream": """
SELECT wf_id, task_name, phase, epoch_us(COALESCE(ended, started)) AS changed_us
FROM fresh_final""",
    "task_phase_stream_rolling": """
SELECT wf_id, task_name, phase, epoch_us(COALESCE(ended, started)) AS changed_us
FROM fresh_final""",
    "task_phase_stream_text_ids": """
SELECT 'ns/wf-' || wf_id AS wf_id, task_name, phase, epoch_us(COALESCE(ended, started)) AS changed_us
FROM fresh_final""",
    "metrics_stream": """
SELECT t.workflow_name, f.task_name, t.image, COALESCE(s.alloc_cpu_m, 0) AS actual_cpu_m,
       COALESCE(s.alloc_mem_mib, 0) AS actual_mem_mib,
       ROUND((epoch_us(ended) - epoch_us(started)) / CAST(1000000 AS DOUBLE) + 1e-9, 6) AS duration_s,
       TRUE AS succeeded, epoch_us(ended) AS completed_us
FROM fresh_final f JOIN wf_tasks t ON t.wf_id = f.wf_id AND t.task_name = f.task_name
LEFT JOIN wf_status s ON s.wf_id = f.wf_id AND s.task_name = f.task_name
WHERE f.phase = 'Succeeded'""",
    "event_stream": """
SELECT wf_id, 'Normal' AS type, 'TaskStarted' AS reason,
       'Started task "' || f.task_name || '" with pod "' || COALESCE(n.workflow_name, CAST(f.wf_id AS STRING)) || '-'
       || f.task_name || '"' AS message
FROM fresh_final f LEFT JOIN (SELECT wf_id, workflow_name FROM wf_tasks WHERE idx = 0) n USING (wf_id) WHERE started IS NOT NULL
UNION ALL SELECT wf_id, 'Normal', 'TaskSucceeded', 'Task "' || task_name || '" completed successfully'
FROM fresh_final WHERE phase = 'Succeeded'
UNION ALL SELECT wf_id, 'Warning', 'TaskFailed', 'Task "' || task_name || '" failed'
FROM fresh_final WHERE phase = 'Failed'""",
    "event_log": """
SELECT wf_id, 'Normal' AS type, 'Initialized' AS reason, 'Workflow initialized with ' || COUNT(*) || ' tasks' AS message
FROM wf_tasks t WHERE NOT EXISTS (SELECT 1 FROM wf_status s WHERE s.wf_id = t.wf_id) GROUP BY wf_id
UNION ALL SELECT wf_id, 'Normal', 'TaskStarted', 'Started task "' || task_name || '" with pod "wf-' || wf_id || '-' || task_name || '"'
FROM run_remote_plan
UNION ALL SELECT wf_id, 'Warning', 'PodCreationFailed',
       'Failed to create pod for task "t999": task "t999" not found in spec' FROM wf_deps WHERE dep = 't999'
UNION ALL SELECT n.wf_id, CASE WHEN n.phase = 'Failed' THEN 'Warning' ELSE 'Normal' END,
       CASE WHEN n.phase = 'Failed' THEN 'TaskFailed' ELSE 'TaskSucceeded' END,
       'Task "' || n.task_name || CASE WHEN n.phase = 'Failed' THEN '" failed' ELSE '" completed successfully' END
FROM synced n JOIN wf_status b ON b.wf_id = n.wf_id AND b.task_name = n.task_name
WHERE b.phase = 'Running' AND n.phase <> 'Running'
UNION ALL SELECT wf_id, CASE WHEN phase = 'Failed' THEN 'Warning' ELSE 'Normal' END,
       CASE WHEN phase = 'Failed' THEN 'WorkflowFailed' ELSE 'WorkflowCompleted' END,
       CASE WHEN phase = 'Failed' THEN 'Workflow failed because task "' || failed_task || '" failed'
            ELSE 'All tasks completed successfully' END
FROM synced_phases n WHERE phase <> 'Running'
AND NOT EXISTS (SELECT 1 FROM phases b WHERE b.wf_id = n.wf_id AND b.phase <> 'Running')""",
}
ORACLES["score_forest_rules"] = """
SELECT wf_id, task_name, CASE WHEN n_samples > 0 THEN 'ml' ELSE method END AS method,
       ROUND(CAST(CASE WHEN n_samples > 0 THEN LEAST(0.9, 0.5 + n_samples * 0.05) ELSE confidence END AS DOUBLE) + 1e-9, 6) AS confidence,
       TRUE AS above_floors, CASE WHEN n_samples = 0 THEN cpu_m END AS cpu_m, CASE WHEN n_samples = 0 THEN mem_mib END AS mem_mib
FROM predicted"""
ORACLES["evaluate_r2_floor"] = """
SELECT UNNEST(['actual_cpu_m', 'actual_mem_mib', 'duration_s', 'mean']) AS target, TRUE AS most_explained"""
ORACLES["forest_on_history"] = """
SELECT target, COUNT(*) AS n_held_out, TRUE AS no_worse_than_mean
FROM wf_executions e JOIN rolling r ON r.image = e.image AND r.completed_at = e.completed_at,
     (SELECT UNNEST(['actual_cpu_m', 'actual_mem_mib', 'duration_s', 'mean']) AS target) t
WHERE e.succeeded AND r.n_samples > 0
  AND CAST('0x' || SUBSTR(SHA256('42|' || workflow_name || '|' || task_name || '|' || e.image || '|' || epoch_us(e.completed_at)), 1, 8) AS BIGINT) % 100 >= 80
GROUP BY target"""
# Three cycles over the documents: t0 always fits, t1 unless it wants 1.5 cores of one.
VIEWS["cycled"] = """
SELECT *, n > 0 AND key % 3 = 0 AND n > 1 AND NOT ((key + 1) % 5 = 2 AND key % 4 = 0) AS next_runs,
       CASE WHEN n = 0 THEN 'Running' WHEN key % 3 = 1 THEN 'Failed'
            WHEN key % 3 = 0 AND n = 1 THEN 'Completed' ELSE 'Running' END AS phase
FROM (SELECT *, COALESCE(n_tasks, 0) AS n FROM docs)
"""
ORACLES["reconcile_cycle"] = """
SELECT namespace, name, phase,
       COALESCE((SELECT STRING_AGG('t' || i || ':' || CASE
           WHEN i = 0 THEN ['Succeeded', 'Failed', 'Running'][key % 3 + 1] || ':' || name || '-t0'
           WHEN i = 1 AND next_runs THEN 'Running:' || name || '-t1' ELSE 'Pending:-' END, ',' ORDER BY i)
         FROM UNNEST(range(0, n)) AS r(i)), '') AS tasks,
       CASE WHEN n = 0 OR phase = 'Completed' THEN NULL WHEN key % 3 > 0 THEN '100m'
            WHEN next_runs THEN ['500m', '1000m', '1500m', '250m', '100m'][(key + 1) % 5 + 1] END AS cpu,
       CASE phase WHEN 'Failed' THEN 'Available:False:TaskFailed:1998-06-03T00:00:00Z,Progressing:False:TaskFailed:1998-06-03T00:00:00Z'
            WHEN 'Completed' THEN 'Available:True:AllTasksSucceeded:1998-06-03T00:00:00Z,Progressing:False:Completed:1998-06-03T00:00:00Z'
            ELSE 'Progressing:True:Reconciling:1998-06-01T00:00:00Z' END AS conditions
FROM cycled"""
ORACLES["reconcile_events"] = """
SELECT wf_id, CASE WHEN key % 3 = 1 THEN 'Warning' ELSE 'Normal' END AS type,
       CASE WHEN key % 3 = 1 THEN 'TaskFailed' ELSE 'TaskSucceeded' END AS reason,
       CASE WHEN key % 3 = 1 THEN 'Task "t0" failed' ELSE 'Task "t0" completed successfully' END AS message
FROM cycled WHERE n > 0 AND key % 3 < 2
UNION ALL SELECT wf_id, 'Warning', 'WorkflowFailed', 'Workflow failed because task "t0" failed' FROM cycled WHERE phase = 'Failed'
UNION ALL SELECT wf_id, 'Normal', 'WorkflowCompleted', 'All tasks completed successfully' FROM cycled WHERE phase = 'Completed'
UNION ALL SELECT wf_id, 'Normal', 'TaskStarted', 'Started task "t1" with pod "' || name || '-t1"' FROM cycled WHERE next_runs"""
_CHANGED = "SELECT p.* FROM run_remote_plan p WHERE p.wf_id IN (SELECT wf_id FROM wf_pod_events)"
ORACLES["plan_changed"] = _CHANGED
ORACLES["plan_stream"] = _CHANGED
ORACLES["plan_stream_again"] = _CHANGED
ORACLES["reconcile_stream"] = ORACLES["reconcile_cycle"]
ORACLES["reconcile_refused"] = """
SELECT wf_id, CASE WHEN n > 0 THEN CASE WHEN key % 4 = 0 THEN 'Pending' ELSE 'Running' END END AS phase,
       CASE WHEN n > 0 AND key % 4 > 0 THEN name || '-t0' END AS pod_name, CASE WHEN n > 0 AND key % 4 > 0 THEN '100m' END AS cpu,
       CASE WHEN n > 0 THEN CASE WHEN key % 4 = 0 THEN 'Warning' ELSE 'Normal' END END AS type,
       CASE WHEN n > 0 AND key % 4 = 0 THEN 'Failed to create pod for task "t0": quota exceeded'
            WHEN n > 0 THEN 'Started task "t0" with pod "' || name || '-t0"' END AS message
FROM cycled"""
ORACLES["plan_changed_kept"] = _CHANGED
ORACLES["image_history_cells"] = ORACLES["image_history"]
ORACLES["ready_stream"] = """
SELECT DISTINCT t.wf_id, t.task_name FROM wf_tasks t
LEFT JOIN after_events p ON p.wf_id = t.wf_id AND p.task_name = t.task_name
WHERE COALESCE(p.phase, 'Pending') = 'Pending' AND NOT EXISTS (
  SELECT 1 FROM wf_deps d LEFT JOIN after_events a ON a.wf_id = d.wf_id AND a.task_name = d.dep
  WHERE d.wf_id = t.wf_id AND d.task_name = t.task_name AND COALESCE(a.phase, 'Pending') <> 'Succeeded')"""


def oracle_sql() -> dict[str, str]:
    return {name: sql(body) for name, body in ORACLES.items()}
