"""Synchronous graph dynamical systems on Spark DataFrames."""

from .model import Config, Model, ModelError, config
from .operators.neighbours import Context
from .operators.transition import DropEdges, HubEdges, NewAgent, NewEdge, Step
from .simulation import Simulation, noop

__all__ = ["Config", "Context", "DropEdges", "HubEdges", "Model", "ModelError", "NewAgent", "NewEdge", "Simulation", "Step", "config", "noop"]
