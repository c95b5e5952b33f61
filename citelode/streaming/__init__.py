"""Live relay of pipeline steps."""
