"""Plain files in the folder that all executors share, written and read by tasks."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

from fleetplan.session import shared_dir


def new_folder(spark: SparkSession, label: str) -> str:
    """The address of a folder of its own below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def write_file(folder: str, name: str, parts: list) -> str:
    """Write one file under a name that no other attempt of the task uses, and return the name.

    A task's rows name the files it has written. Readers go by those rows, so what a lost or repeated
    attempt leaves behind is never read.
    """
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    full = f"{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(f"{root}/{full}") as out:
        for part in parts:
            out.write(part)
    return full


def read_file(folder: str, name: str) -> bytes:
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{root}/{name}") as file:
        return file.read()
