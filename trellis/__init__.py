"""trellis: leak-safe tabular model analytics as lazy Spark DataFrame operators.

Modules: ``operators`` (prep, split, profile, quantiles, metrics, curves,
resample, transform, models, explain), ``sources`` (io), ``functions``
(column helpers, report strings), ``plans`` (workflows, driver catalogue,
command line), ``streaming`` (stream scoring), ``session``.

The few operators that run Python on executors (``mapInPandas`` /
``applyInPandas``) close over functions of this package. The package is
registered for by-value pickling, so Python workers do not need it
installed; shipping it with ``--py-files`` works as well.
"""

import sys as _sys

__version__ = "0.1.0"

try:  # PySpark's bundled cloudpickle
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle without the feature
    pass
