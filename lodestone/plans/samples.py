"""Small literal inputs for the queries that need sources of their own."""

NAMES = (
    ("get_item", "function", None, 2), ("setup", "method", "Trainer", 0), ("on_train_start", "method", "Hook", 1), ("__len__", "method", "Bag", 1),
    ("__matmul__", "method", "Mat", 2), ("__init__", "method", None, 3), ("maxSpeed", "property", "Car", 0), ("is_ready", "function", None, 0),
    ("compute_loss", "method", "Net", 5), ("get", "function", None, 1), ("unregister_all", "function", None, 4), ("frobnicate", "function", None, 3),
    ("myFunnyName", "function", None, 0), ("_set_up_", "method", "A", 0), ("pre_reset", "function", "", 0),
)

SOURCES = (
    (
        "pkg/a.py",
        'import os\n\n\nclass Base(object):\n    """A base class of all."""\n\n    @staticmethod\n    def make(x, *, y: int = 1) -> int:\n        if x and y or os:\n            return 1\n        return 2\n\n    @property\n    def size(self):\n        return [i for i in range(3)]\n\n    def run(self, a, b=(1, 2), *args, **kw):\n        \'\'\'Runs it all.\n\n        At length.\n        \'\'\'\n        def inner():\n            pass\n        for x in a:\n            with b:\n                pass\n\n    class Nested(Base, abc.ABC):\n        def go(self):\n            return "a#b"  # note\n\n\nif True:\n    async def late():\n        "Too late."\n',
    ),
    ("pkg/broken.py", "def f(:\n"),
    ("pkg/empty.py", ""),
)

RST = (
    (0, "Title\n=====\n\nText with :class:`Foo` and `x <u>`_ .\n"),
    (1, "Sub\n---\n\na\n}\n"),
    (2, ".. note:: hi\n\n   body\n\nend\n"),
    (3, ".. code-block:: python\n   :linenos:\n\n   x = 1\n\nafter::\n\n    literal\n\nend\n"),
    (4, ":orphan:\n\n.. _lab:\n\n====\nOver\n====\n\n.. image:: a.png\n   :alt: b\n\n\n\nlast |sub| ``lit``\n"),
    (5, ""),
)
