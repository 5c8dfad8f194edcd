"""Package audits, report contracts and table analytics on Spark."""
