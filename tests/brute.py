"""Plain-Python versions of the sequential rules, for small fixtures."""


def admit(tasks, cap_cpu, cap_mem, used_cpu=0, used_mem=0):
    """tasks: (idx, cpu, mem) in any order; returns admitted idx in order."""
    out = []
    for idx, cpu, mem in sorted(tasks):
        if cap_cpu and used_cpu + cpu > cap_cpu:
            continue
        if cap_mem and used_mem + mem > cap_mem:
            continue
        used_cpu, used_mem = used_cpu + cpu, used_mem + mem
        out.append(idx)
    return out


def ready(names, deps, phase):
    return [
        n for n in names
        if phase.get(n, "Pending") == "Pending" and all(phase.get(d) == "Succeeded" for d in deps.get(n, []))
    ]


def longest(durations, deps):
    """Start per task, or None for tasks on or behind a cycle. Unknown dependencies count as 0."""
    start = {}
    left = set(durations)
    while True:
        free = [n for n in left if all(d in start or d not in durations for d in deps.get(n, []))]
        if not free:
            return {**start, **{n: None for n in left}}
        for n in free:
            start[n] = max([start[d] + durations[d] for d in deps.get(n, []) if d in durations] or [0.0])
        left -= set(free)


def stuck(names, deps):
    done = set()
    while True:
        free = [n for n in names if n not in done and all(d in done for d in deps.get(n, []))]
        if not free:
            return {n for n in names if n not in done}
        done |= set(free)


def fold(events, phase="Pending"):
    for _, _, kind in sorted(events):
        if phase == "Pending" and kind == "Running":
            phase = "Running"
        elif phase == "Running" and kind in ("Succeeded", "Failed"):
            phase = kind
    return phase
