"""Named queries over the driver's tables, each with SQL to hold it against where SQL can express it."""
