"""framelake: a PySpark engine for episodic time-step datasets.

The core holds the dataset model (frames, episodes, tasks, statistics), its
readers, writers, validators and converters, and the general data-quality
operators.  The subpackage ``llm`` builds on the core and is optional: nothing
in the core imports it.
"""

__version__ = "0.1.0"
