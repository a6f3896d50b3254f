"""One limit of concurrent calls for a whole job, over all executors.

The driver listens on a port and lends out leases; a worker takes one for each call
and gives it back by closing its connection, so a call of a worker or an executor
that is lost gives its lease back as well. Only one thread of a worker waits for a
lease at a time, so the driver holds a connection for each running call and one for
each worker.
"""

from __future__ import annotations

import asyncio
import hmac
import secrets
import socket
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession

#: Seconds after which a silent connection is probed, and between probes; three without an answer end it.
PROBE_SECONDS = 30


def _probed(s: socket.socket) -> None:
    s.setsockopt(socket.SOL_SOCKET, socket.SO_KEEPALIVE, 1)
    for name, value in (("TCP_KEEPIDLE", PROBE_SECONDS), ("TCP_KEEPINTVL", PROBE_SECONDS), ("TCP_KEEPCNT", 3)):
        if hasattr(socket, name):
            s.setsockopt(socket.IPPROTO_TCP, getattr(socket, name), value)


class CallLimit:
    """Lends out ``most`` leases; use it as a context around the action that runs the calls, and give ``lease`` to the tasks.

    Leases go to whoever waits longest. ``peak`` is how many were out at once at most, ``lent`` how many were given.
    """

    def __init__(self, spark: SparkSession, most: int, host: str | None = None):
        if most < 1:
            raise ValueError("a call limit is one at least")
        self.host = host or spark.sparkContext.getConf().get("spark.driver.host") or socket.gethostname()
        self.most, self.peak, self.lent, self._out = most, 0, 0, 0
        self._secret = secrets.token_hex(16)
        self._loop = asyncio.new_event_loop()
        self._free = asyncio.Semaphore(most)
        self._server = self._loop.run_until_complete(asyncio.start_server(self._lend, "0.0.0.0", 0, backlog=4096))
        self._port = self._server.sockets[0].getsockname()[1]
        self._thread = threading.Thread(target=self._loop.run_forever, daemon=True)
        self._thread.start()

    @property
    def lease(self) -> Leases:
        return Leases(self.host, self._port, self._secret)

    async def _lend(self, reader: asyncio.StreamReader, writer: asyncio.StreamWriter) -> None:
        try:
            _probed(writer.get_extra_info("socket"))
            if not hmac.compare_digest(await asyncio.wait_for(reader.readexactly(len(self._secret)), PROBE_SECONDS), self._secret.encode()):
                return
            async with self._free:
                self._out, self.lent = self._out + 1, self.lent + 1
                self.peak = max(self.peak, self._out)
                try:
                    writer.write(b"1")
                    await writer.drain()
                    await reader.read(1)  # ends when the worker closes, or is gone
                finally:
                    self._out -= 1
        except (OSError, EOFError, TimeoutError):
            pass
        finally:
            writer.close()

    def close(self) -> None:
        if self._loop.is_running():
            asyncio.run_coroutine_threadsafe(self._ended(), self._loop).result(10)
            self._loop.call_soon_threadsafe(self._loop.stop)
            self._thread.join(10)
            self._loop.close()

    async def _ended(self) -> None:
        self._server.close()
        waiting = [t for t in asyncio.all_tasks() if t is not asyncio.current_task()]
        for t in waiting:
            t.cancel()
        await asyncio.gather(*waiting, return_exceptions=True)

    def __enter__(self) -> CallLimit:
        return self

    def __exit__(self, *_: Any) -> None:
        self.close()


@dataclass(frozen=True)
class Leases:
    """Where a worker gets its leases; goes to the tasks with their function."""

    host: str
    port: int
    secret: str

    def taker(self) -> Callable[[], Any]:
        """For one worker: a function whose context holds a lease. A driver that is gone is an error of the call."""
        turn = threading.Lock()

        @contextmanager
        def held() -> Iterator[None]:
            s = None
            try:
                with turn:
                    s = socket.create_connection((self.host, self.port), timeout=PROBE_SECONDS)
                    _probed(s)
                    s.sendall(self.secret.encode())
                    s.settimeout(None)
                    if s.recv(1) != b"1":
                        raise ConnectionError("the call limit has ended")
                yield
            finally:
                if s is not None:
                    s.close()

        return held
