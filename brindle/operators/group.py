"""Tasks of one barrier stage that work on their rows together: sums and values between them go over sockets, not over Spark jobs."""

from __future__ import annotations

import json
import pickle
import secrets
import socket
import struct
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

WAIT_S = 1800  # for the slowest task of a step


class Group:
    """The tasks of the stage; task 0 gathers. All have to call the same methods in the same order. A task that ends ends the others, and the stage is run again."""

    def __init__(self, rank: int, peers: list[socket.socket]):
        self.rank, self.peers = rank, peers  # task 0 has the others, each other has task 0

    @classmethod
    def of_stage(cls) -> Group:
        from pyspark import BarrierTaskContext

        context = BarrierTaskContext.get()
        rank, hosts = context.partitionId(), [x.address.rpartition(":")[0] for x in context.getTaskInfos()]
        if rank:
            port, token = json.loads(context.allGather("")[0])
            peer = socket.create_connection((hosts[0], port), WAIT_S)
            peer.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
            peer.sendall(token.encode() + struct.pack("<q", rank))
            return cls(rank, [peer])
        with socket.create_server((hosts[0], 0), backlog=len(hosts)) as server:
            server.settimeout(WAIT_S)
            token = secrets.token_hex(16)
            context.allGather(json.dumps([server.getsockname()[1], token]))
            by_rank: dict[int, socket.socket] = {}
            while len(by_rank) < len(hosts) - 1:
                peer = server.accept()[0]
                peer.settimeout(WAIT_S)
                peer.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
                said = bytes(_read(peer, 40))
                if secrets.compare_digest(said[:32], token.encode()):
                    by_rank[struct.unpack("<q", said[32:])[0]] = peer
        return cls(0, [by_rank[k] for k in sorted(by_rank)])

    def total(self, values):
        """At task 0 the sum of all tasks' arrays, in the order of the tasks; None elsewhere."""
        if self.rank:
            self.peers[0].sendall(memoryview(values).cast("B"))
            return None
        import numpy as np

        out = values.copy()
        for peer in self.peers:
            out += np.frombuffer(_read(peer, values.nbytes), values.dtype).reshape(values.shape)
        return out

    def gathered(self, value: Any) -> list | None:
        """At task 0 the values of all tasks; None elsewhere."""
        if self.rank:
            _send(self.peers[0], value)
            return None
        return [value, *(_receive(p) for p in self.peers)]

    def shared(self, value: Any = None) -> Any:
        """At all tasks the value of task 0."""
        if self.rank:
            return _receive(self.peers[0])
        for p in self.peers:
            _send(p, value)
        return value


def _read(peer: socket.socket, n: int) -> bytearray:
    out = bytearray(n)
    view = memoryview(out)
    while n:
        got = peer.recv_into(view[-n:], n)
        if not got:
            raise ConnectionError("another task of the stage has ended")
        n -= got
    return out


def _send(peer: socket.socket, value: Any) -> None:
    data = pickle.dumps(value, 5)
    peer.sendall(struct.pack("<q", len(data)) + data)


def _receive(peer: socket.socket) -> Any:
    return pickle.loads(_read(peer, struct.unpack("<q", _read(peer, 8))[0]))


def together(rows: DataFrame, work: Callable[[Group, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What the tasks give of `work`, one on each core of the cluster, all at once, each on its share of the rows; each action does it again."""
    sc = rows.sparkSession.sparkContext._jsc.sc()
    tasks = max(1, sc.maxNumConcurrentTasks(sc.resourceProfileManager().defaultResourceProfile()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = Group.of_stage()
        yield from work(group, batches)
        for peer in group.peers:
            peer.close()

    return rows.repartition(tasks).mapInArrow(run, schema, barrier=True)
