"""Tables in and out of files, and tables out of stored web pages."""
