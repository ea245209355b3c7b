"""Small workflow documents in the shapes that matter: chain, fan-out, gather,
diamond, a wide layered graph, and a long multi-stage one."""


def task(name, deps=(), cpu=None, mem=None, image="busybox"):
    t = {"name": name, "image": image}
    if deps:
        t["dependencies"] = list(deps)
    if cpu is not None or mem is not None:
        t["baseResources"] = {"requests": {"cpu": cpu, "memory": mem}}
    return t


def document(name, cpu, mem, tasks, namespace=None):
    meta = {"name": name}
    if namespace:
        meta["namespace"] = namespace
    return {"metadata": meta, "spec": {"maxResources": {"cpu": cpu, "memory": mem}, "tasks": tasks}}


def chain(n=3):
    return [task(f"c{i}", [f"c{i - 1}"] if i else []) for i in range(n)]


def fan(n=3):
    return [task("root"), *[task(f"leaf{i}", ["root"]) for i in range(n)]]


def gather(n=3):
    return [*fan(n), task("sum", [f"leaf{i}" for i in range(n)])]


def trainer():
    return [
        task("load", [], "500m", "512Mi"),
        task("clean", ["load"], "1", "1Gi"),
        task("fit-a", ["clean"], "2", "2Gi"),
        task("fit-b", ["clean"], "2", "2Gi"),
        task("judge", ["fit-a", "fit-b"], "500m", "256Mi"),
    ]


def diamond():
    return [
        task("top"),
        task("left", ["top"]),
        task("left-end", ["left"]),
        task("right", ["top"]),
        task("middle", ["left", "right"]),
        task("bottom", ["left-end", "middle"]),
    ]


def layered():
    """1 -> 10 -> 20 -> 10 -> 10 -> 1, neighbours feeding the next layer."""
    tasks = [task("start")]
    tasks += [task(f"in{i}", ["start"], "20m", "32Mi") for i in range(10)]
    tasks += [task(f"work{i}", [f"in{i % 10}", f"in{(i + 1) % 10}"], "40m", "64Mi") for i in range(20)]
    tasks += [task(f"sum{i}", [f"work{2 * i}", f"work{2 * i + 1}"], "60m", "128Mi") for i in range(10)]
    tasks += [task(f"check{i}", [f"sum{i}"], "20m", "32Mi") for i in range(10)]
    return tasks + [task("end", [f"check{i}" for i in range(10)], "100m", "128Mi")]


def etl():
    return [
        task("get-a", [], "200m", "128Mi"),
        task("get-b", [], "200m", "128Mi"),
        task("map-a", ["get-a"], "300m", "256Mi"),
        task("map-b", ["get-b"], "300m", "256Mi"),
        task("join", ["map-a", "map-b"], "500m", "512Mi"),
        task("store", ["join"], "200m", "128Mi"),
        task("tell", ["store"]),
    ]


# name -> (cap cpu, cap memory, tasks, edges, depth, waves of (n, cpu, memory))
GOLDEN = {
    "chain": ("1", "512Mi", chain(), 2, 3, [(1, 100, 128)] * 3),
    "fan": ("2", "1Gi", fan(), 3, 2, [(1, 100, 128), (3, 300, 384)]),
    "gather": ("3", "2Gi", gather(), 6, 3, [(1, 100, 128), (3, 300, 384), (1, 100, 128)]),
    "trainer": (
        "4", "4Gi", trainer(), 5, 4,
        [(1, 500, 512), (1, 1000, 1024), (2, 4000, 4096), (1, 500, 256)],
    ),
    "diamond": (
        "2", "1Gi", diamond(), 7, 4,
        [(1, 100, 128), (2, 200, 256), (2, 200, 256), (1, 100, 128)],
    ),
    "layered": (
        "1", "1Gi", layered(), 90, 6,
        [(1, 100, 128), (10, 200, 320), (16, 640, 1024), (10, 520, 1024), (10, 360, 704), (4, 80, 128), (1, 100, 128)],
    ),
    "etl": (
        "2", "1Gi", etl(), 6, 5,
        [(2, 400, 256), (2, 600, 512), (1, 500, 512), (1, 200, 128), (1, 100, 128)],
    ),
}
