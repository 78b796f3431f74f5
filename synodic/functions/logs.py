"""Logging of steps to a file, and plots of globals."""

from __future__ import annotations

import contextlib
import logging
import os


def create_logger(name: str, folder: str = ".", debug: bool = False) -> logging.Handler:
    """A handler that writes the package's records, with begin and end of each step, to folder/name.log on the driver."""
    os.makedirs(folder, exist_ok=True)
    handler = logging.FileHandler(os.path.join(folder, f"{name}.log"))
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    handler.setLevel(logging.DEBUG if debug else logging.INFO)
    return handler


@contextlib.contextmanager
def with_logger(handler: logging.Handler):
    """Records go to the handler inside."""
    own = logging.getLogger("synodic")
    before = own.level
    own.addHandler(handler)
    own.setLevel(handler.level)
    try:
        yield handler
    finally:
        own.removeHandler(handler)
        own.setLevel(before)
        handler.close()


def plot_globals(sim, names: list[str]):
    """A figure with a line for each vector global; needs matplotlib."""
    try:
        from matplotlib.figure import Figure
    except ImportError as e:
        raise RuntimeError("plots need matplotlib") from e
    figure = Figure()
    axis = figure.add_subplot()
    for name in names:
        axis.plot(range(len(sim.get_global(name))), sim.get_global(name), label=name)
    axis.legend()
    return figure
