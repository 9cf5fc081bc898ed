"""Readers over landed responses and files, each giving rows of one raw-record shape."""
