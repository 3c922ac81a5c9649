"""tabreg package."""
