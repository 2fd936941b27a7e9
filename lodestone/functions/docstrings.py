"""Made-up docstrings for code without any, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name beginnings and their verbs, in the order they are tried.
VERBS = (
    ("get", "Retrieves"), ("set", "Sets"), ("is_", "Checks if"), ("has_", "Checks if has"), ("can_", "Checks if can"),
    ("should_", "Determines if should"), ("create", "Creates"), ("build", "Builds"), ("make", "Creates"), ("init", "Initializes"),
    ("setup", "Sets up"), ("configure", "Configures"), ("load", "Loads"), ("save", "Saves"), ("read", "Reads"),
    ("write", "Writes"), ("parse", "Parses"), ("process", "Processes"), ("handle", "Handles"), ("validate", "Validates"),
    ("check", "Checks"), ("compute", "Computes"), ("calculate", "Calculates"), ("convert", "Converts"), ("transform", "Transforms"),
    ("update", "Updates"), ("delete", "Deletes"), ("remove", "Removes"), ("add", "Adds"), ("append", "Appends"),
    ("insert", "Inserts"), ("find", "Finds"), ("search", "Searches for"), ("filter", "Filters"), ("sort", "Sorts"),
    ("reset", "Resets"), ("clear", "Clears"), ("start", "Starts"), ("stop", "Stops"), ("run", "Runs"),
    ("execute", "Executes"), ("call", "Calls"), ("invoke", "Invokes"), ("register", "Registers"), ("unregister", "Unregisters"),
    ("connect", "Connects"), ("disconnect", "Disconnects"), ("open", "Opens"), ("close", "Closes"), ("enable", "Enables"),
    ("disable", "Disables"), ("log", "Logs"), ("print", "Prints"), ("format", "Formats"), ("render", "Renders"),
    ("display", "Displays"), ("on_", "Callback for"),
)

# Texts for special methods; {class_name} stands for the class.
DUNDERS = {
    "__init__": "Initializes the {class_name} instance with the given parameters.",
    "__str__": "Returns a human-readable string representation of the {class_name}.",
    "__repr__": "Returns a detailed string representation of the {class_name} for debugging.",
    "__len__": "Returns the length/size of the {class_name}.",
    "__iter__": "Returns an iterator over the {class_name}.",
    "__next__": "Returns the next item in the iteration.",
    "__getitem__": "Gets an item from the {class_name} by key/index.",
    "__setitem__": "Sets an item in the {class_name} by key/index.",
    "__delitem__": "Deletes an item from the {class_name} by key/index.",
    "__contains__": "Checks if an item is contained in the {class_name}.",
    "__call__": "Makes the {class_name} instance callable.",
    "__enter__": "Enters the context manager for the {class_name}.",
    "__exit__": "Exits the context manager for the {class_name}.",
    "__eq__": "Checks equality between {class_name} instances.",
    "__hash__": "Returns the hash value of the {class_name}.",
    "__bool__": "Returns the boolean value of the {class_name}.",
    "__getattr__": "Gets an attribute of the {class_name} dynamically.",
    "__setattr__": "Sets an attribute of the {class_name}.",
    "__del__": "Destructor for the {class_name} instance.",
    "__new__": "Creates a new instance of {class_name}.",
    "__add__": "Defines addition behavior for {class_name}.",
    "__sub__": "Defines subtraction behavior for {class_name}.",
    "__mul__": "Defines multiplication behavior for {class_name}.",
    "__truediv__": "Defines division behavior for {class_name}.",
    "__lt__": "Defines less-than comparison for {class_name}.",
    "__le__": "Defines less-than-or-equal comparison for {class_name}.",
    "__gt__": "Defines greater-than comparison for {class_name}.",
    "__ge__": "Defines greater-than-or-equal comparison for {class_name}.",
}

# What follows a class's readable name, by a part of its name.
CLASS_KINDS = (
    ("Callback", "callback for PyTorch Lightning training."),
    ("Strategy", "strategy for distributed training."),
    ("Logger", "logger for experiment tracking."),
    ("Module", "module for PyTorch Lightning."),
    ("Trainer", "for training PyTorch Lightning models."),
    ("Loop", "loop for training/validation/prediction."),
    ("Connector", "connector for configuration and setup."),
    ("Mixin", "mixin providing additional functionality."),
)


def readable_name(name: Column) -> Column:
    """snake_case or camelCase as lower-case words."""
    return F.trim(F.lower(F.regexp_replace(F.replace(name, F.lit("_"), F.lit(" ")), r"([a-z])([A-Z])", "$1 $2")))


def readable_class(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"([A-Z])", " $1"))


def function_doc(name: Column, entity_type: Column, class_name: Column, parameters: Column) -> Column:
    """A sentence for a function from its name, parameters and class."""
    owner = F.coalesce(class_name, F.lit("object"))
    special = F.concat(F.lit("Special method "), name, F.lit(" for "), owner, F.lit("."))
    for dunder, text in DUNDERS.items():
        special = F.when(name == dunder, F.replace(F.lit(text), F.lit("{class_name}"), owner)).otherwise(special)
    table = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(v).alias("v")) for p, v in VERBS])
    hit = F.get(F.filter(table, lambda e: F.startswith(name, e["p"]) | F.contains(name, F.concat(F.lit("_"), e["p"]))), F.lit(0))
    rest = F.regexp_replace(F.replace(name, hit["p"], F.lit("")), r"^_+|_+$", "")
    what = F.when(rest == "", F.lit("the operation")).otherwise(readable_name(rest))
    action = F.when(hit.isNotNull(), F.concat(hit["v"], F.lit(" "), what, F.lit("."))).otherwise(F.concat(F.lit("Performs "), readable_name(name), F.lit(" operation.")))
    parameters = F.coalesce(parameters, F.array().cast("array<string>"))
    n = F.size(parameters)
    more = F.when(n > 3, F.concat(F.lit(", and "), (n - 3).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    takes = F.when(n > 0, F.concat(F.lit("Takes parameters: "), F.array_join(F.slice(parameters, 1, 3), ", "), more, F.lit(".")))
    method = F.when(class_name.isNotNull() & (class_name != ""), F.concat(F.lit("Method of "), class_name, F.lit(".")))
    plain = F.concat_ws(" ", action, takes, method)
    prop = F.concat(F.lit("Property that returns the "), readable_name(name), F.lit("."))
    is_dunder = F.startswith(name, F.lit("__")) & F.endswith(name, F.lit("__"))
    return F.when(is_dunder, special).when(entity_type == "property", prop).otherwise(plain)


def class_doc(name: Column, parents: Column) -> Column:
    """A sentence for a class from its name and parents."""
    text = F.concat(readable_class(name), F.lit(" class."))
    for part, rest in reversed(CLASS_KINDS):
        text = F.when(F.contains(name, F.lit(part)), F.concat(readable_class(name), F.lit(" " + rest))).otherwise(text)
    inherits = F.when(F.size(F.coalesce(parents, F.array().cast("array<string>"))) > 0, F.concat(F.lit("Inherits from: "), F.array_join(parents, ", "), F.lit(".")))
    return F.concat_ws(" ", text, inherits)
