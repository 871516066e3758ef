from . import detection, estimates, estimator, shapes, wordings  # noqa: F401  (register their queries beside those of `queries`)
